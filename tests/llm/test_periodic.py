"""Runs against brute force over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkgrid.llm import periodic
from inkgrid.llm.tables import mixed

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(words, least=12):
    """(start, length, period) of every run, by comparing words a period apart."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def found(texts, least=12):
    values = mixed(np.array([w for t in texts for w in t], np.uint64) + np.uint64(7))
    part = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    before = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in periodic.runs_of(values, part, least))):
        k = int(np.searchsorted(before, s, "right")) - 1
        out[k].append((s - int(before[k]), e - s, q))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4), st.sampled_from([2, 3, 6, 12]))
def test_runs_of_small_alphabets(texts, least):
    assert found(texts, least) == [brute(t, least) for t in texts]


def test_runs_of_repetitive_texts():
    rng = random.Random(3)
    texts = [[0] * 300, [0, 1] * 90 + [2], list(range(100)), [], [1]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(k).count("1") % 2 for k in range(512)]
    texts += [[ord(c) for c in fib[-1]], thue, thue * 2 + [5] + thue]
    for _ in range(150):
        base = [rng.randrange(rng.choice([2, 5, 1000])) for _ in range(rng.randrange(1, 60))]
        t = base * rng.randrange(1, 9)
        t = [rng.randrange(9) for _ in range(rng.randrange(9))] + t + base[: rng.randrange(len(base) + 1)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(len(t))] = rng.randrange(9)
        texts.append(t)
    assert found(texts) == [brute(t) for t in texts]


def test_grammar_gives_the_text_back():
    rng = random.Random(1)
    symbols = np.array([rng.randrange(4) for _ in range(400)] + [7, 8, 9] * 50)
    part = np.repeat([0, 1, 2], [150, 250, 150])
    rule, start, left, length = periodic.grammar(symbols, part)
    words = {}
    for r, s, a, n in zip(rule.tolist(), start.tolist(), left.tolist(), length.tolist()):
        assert 0 < a < n and part[s] == part[s + n - 1]
        assert words.setdefault(r, tuple(symbols[s : s + n])) == tuple(symbols[s : s + n])
    assert {(0, 150), (150, 250), (400, 150)} <= set(zip(start.tolist(), length.tolist()))  # each part becomes one symbol
    assert len(words) < len(rule)


def answer(i, text):
    words = WORD.findall((text or "").encode())
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    runs = brute(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = (sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return (i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), *digests)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r[0]: tuple(r) for r in periodic.op12(spark, sf_dir).collect()}
    assert len(got) == len(texts) and all(got[i] == answer(i, t) for i, t in texts)
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b\vc\n" * 40), (None, "x " * 30), (5, "é\xa0 " * 13), (6, "a " * 11), (7, "The the " * 9 + "the"), (8, "a b c d e f g h"), (8, "z " * 50000), (30, "k " * 40), (30, "k " * 40)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, runs int, collapsed string")
    got = periodic.digests(periodic.periodic_runs(periodic.planted(docs))).collect()
    want = sorted(str(answer(i, t)) for i, t in rows if not t or len(t) < 9999)
    long = [tuple(r) for r in got if r["length"] == 50000]
    assert len(long) == 1 and long[0][1:6] == (1, 0, 50000, 1, 50000000)
    assert sorted(str(tuple(r)) for r in got if r["length"] != 50000) == want
    assert periodic.op12.__name__ and periodic.periodic_runs(docs.limit(0)).count() == 0


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("a", "x y " * 10)], "name string, body string")
    r = periodic.periodic_runs(docs, "body", "name").first()
    assert r["name"] == "a" and [tuple(x) for x in r["runs"]] == [(0, 20, 2)] and r["collapsed"] == "x y"
