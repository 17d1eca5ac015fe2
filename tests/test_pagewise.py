"""Whole pages as packed bodies: the same results as the ways that spread a page, wherever its rows lie."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


from inkgrid.operators import pagewise, stitch

from .test_stitch import KINDS, page

SCHEMA = "page_id int, seq int, y1 int, x1 int, y2 int, x2 int, confidence double, value string"


def irregular():
    """Pages of all kinds, of a grid, and one with nulls; null is a page as well."""
    pages = {k: page(KINDS[k % 4], k) for k in range(40)}
    pages[None] = page("scattered", 99)
    pages[77] = [(40 * (i // 8), 60 * (i % 8), 40 * (i // 8) + 20, 60 * (i % 8) + 8 * (1 + i * i % 7)) for i in range(100)]
    rows = [(k, i, *b, (i * 37 % 64) / 64, f"w{i}é") for k, bs in pages.items() for i, b in enumerate(bs)]
    return rows + [(78, 0, 0, 0, 20, 50, None, "a"), (78, 1, 0, 55, 20, 80, 0.5, None), (78, 2, None, 0, 9, 9, None, None), (78, 3, 50, 0, 60, 90, 0.25, "b")]


def plain(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


@pytest.mark.parametrize("lie", ["by page", "anyhow"])
@pytest.mark.parametrize("most", [30, 1 << 16])
def test_lines_and_blocks_are_those_of_the_spread_way(spark, monkeypatch, lie, most):
    monkeypatch.setattr(pagewise, "MOST", most)
    rows = irregular()
    if lie == "anyhow":
        random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if lie == "anyhow" else spark.createDataFrame(rows, SCHEMA)
    spread = lambda m: stitch.summarize_groups(stitch.stitch_lines(m), "line_seq", "x1", " ")
    whole = df.filter("page_id is null or page_id <> 78")
    lines = stitch.lines_of(whole)
    assert plain(lines) == plain(spread(whole)) and lines.count() > 300
    as_blocks = lambda m: m.withColumnRenamed("seq", "line_seq")
    assert plain(stitch.blocks_of(as_blocks(whole))) == plain(stitch.summarize_groups(stitch.stitch_blocks(as_blocks(whole)), "block_seq", "y1", "\n"))
    assert stitch.lines_of(df.limit(0)).count() == 0
    if most > 30:
        got = stitch.lines_of(df.filter("page_id = 78")).select("n", "confidence", "value").collect()
        assert sorted(map(tuple, got), key=str) == [(1, 0.25, "b"), (1, None, ""), (2, 0.5, "a")]


def test_lines_of_a_page_move_little(spark, tmp_path):
    """What is shuffled for a page of words is about as long as its words."""
    n = 40000
    rng = np.random.default_rng(2)
    df = spark.range(0, n, 1, 1).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("seq"), (F.floor(F.col("id") / 8) * 40).cast("int").alias("y1"), (F.col("id") % 8 * 60).cast("int").alias("x1"))
    df = df.selectExpr("page_id", "seq", "y1", "x1", "y1 + 20 as y2", "x1 + 40 as x2", "seq / 64.0D as confidence", "substr(md5(string(seq)), 1, 6) as value")
    rows = df.toArrow()
    columns = pagewise.Columns([f for f in df.schema.fields if f.name != "page_id"])
    body = columns.bodies(rows, np.array([0, n]))[0]
    assert len(body) < 8 * n
    got = columns.rows([body], [rows.schema.field(c).type for c, _ in columns.fields])
    assert all(a.equals(rows.column(c).combine_chunks()) for a, (c, _) in zip(got, columns.fields))


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_collisions_and_exports_are_the_same_for_large_and_small_pages(spark, monkeypatch, most):
    """Against loops; with most 0 every page is spread."""
    from inkgrid.operators import score
    from inkgrid.sources import tables as src

    monkeypatch.setattr(pagewise, "MOST", most)
    rows = [r for r in irregular() if r[0] is None or r[0] != 78]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    grid = df.select("page_id", F.col("seq").alias("box_id"), "y1", "x1", "y2", "x2", F.lit(300).alias("n_rows"), F.lit(300).alias("n_cols"))
    want = {(r[0], r[1], None) for r in rows if r[4] > 300 or r[5] > 300}
    for k in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == k]
        want |= {(k, a[1], b[1]) for a in mine for b in mine if a[1] < b[1] and a[3] < b[5] and b[3] < a[5] and a[2] < b[4] and b[2] < a[4]}
    got = [tuple(r) for r in score.collisions(grid).collect()]
    assert set(got) == want and len(got) == len(want)

    pages = spark.createDataFrame([(k, f"f{k // 2}", f"s{k}", k) for k in range(90)], "page_id int, filename string, sha256 string, place int")
    import json

    files = {r["filename"]: json.loads(r["json"]) for r in src.export_pages(pages, df).collect()}
    assert len(files) == 45
    for k in range(1, 90, 2):
        mine = sorted((r[6], r[1], r[7]) for r in rows if r[0] == k)
        assert [(m["confidence"], m["value"]) for m in files[f"f{k // 2}"]["matches"]] == [(c, v) for c, _, v in mine]
    lines: dict = {}
    for r in src.export_lines(pages, df).collect():
        lines.setdefault(r["filename"], {})[r["line"]] = r["json"]
    assert {f: json.loads("".join(x[i] for i in range(len(x)))) for f, x in lines.items()} == files
