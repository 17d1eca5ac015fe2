"""Mixing against a loop over documents, and shares against resharing in rounds."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import mixing


def reshared(sizes, weights, most):
    """Targets by the rule: shares by weight, cut at the cap, the excess reshared until none is above."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        want = [most * s if i in capped else left * weights[i] / free for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(want) if t > most * sizes[i] and i not in capped}
        if not above:
            return want
        capped |= above


def mixed(rows, most=3):
    """rows (doc_id, source, text) as (doc_id, size, source_size, target, taken), one document after another."""
    by = collections.defaultdict(list)
    for i, source, text in rows:
        text = text or ""
        mark = hashlib.md5(f"mix|{'' if i is None else i}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        quality = 1 / (1 + 20 * sum(c in mixing.SIGNS for c in text) / max(1, len(text)))
        key = -math.log((int(mark[:13], 16) + 0.5) / 16**13) / quality
        by[source].append((key, mark, i, len(text.encode().split())))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[3] for d in by[s]) for s in order]
    out = []
    for source, size, target in zip(order, sizes, reshared(sizes, [k % 3 + 1 for k in range(len(order))], most)):
        epochs = int(target // size) if size else 0
        left = round(target - epochs * size)
        for _, _, i, n in sorted(by[source], key=lambda d: (d[0], d[1])):
            took = max(0, min(n, left))
            left -= took
            out.append((i, n, size, target, epochs * n + took))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (*g[:3], g[4]) == (*w[:3], w[4]) and g[3] == pytest.approx(w[3])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    source = ["hot"] * 20 + ["a", "b", "é", "zz", None, "", "tiny"]
    out = [(k, rng.choice(source), " ".join(rng.choice(["w", "x1", "#", "long"]) for _ in range(rng.randrange(40)))) for k in range(400)]
    out += [(None, "a", "null id"), (None, None, None), (5, "empty", None), (6, "empty", ""), (7, "one", "just one"), (8, "hot", "x " * 5000)]
    return out + [(9, "b", "the same row")] * 30 + [(None, "hot", "copies of null")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "row", 7, "up") for r in rows], "doc_id long, source string, text string, k string, row string, size int, __key string")


def test_mixture_matches_a_loop(spark, rows):
    got = mixing.mix(frame(spark, rows)).cache()
    compare(got.select("doc_id", "size", "source_size", "target", "taken").collect(), mixed(rows))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 0.5 + 1e-9 for r in per)
    assert got.filter("taken > 3 * size or taken < epochs * size").count() == 0


def test_order_of_rows_does_not_matter(spark, rows):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    first = sorted(map(str, mixing.mix(frame(spark, rows)).select(*columns).collect()))
    other = sorted(map(str, mixing.mix(frame(spark, rows[::-1]).repartition(3)).select(*columns).collect()))
    assert first == other


def test_targets_as_reshared_in_rounds(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = [rng.choice([0, 1, 3, 50, 1000, 10**6]) for _ in range(n)]
        names = [f"s{k:03d}" for k in range(n)]
        table = spark.createDataFrame([(k, k, s) for k, s in zip(names, sizes)], "k string, source string, source_size long")
        got = {r["k"]: r["target"] for r in mixing.targets(table).collect()}
        want = reshared(sizes, [k % 3 + 1 for k in range(n)], 3)
        assert [got[k] for k in names] == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(sum(sizes))


def test_better_documents_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "few").otherwise("many").alias("source"), F.lit("one two three").alias("text"))
    taken = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0), weights=(1, 1), most=3)
    r = taken.filter("source = 'many'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("taken").alias("t")).collect()
    t = {x["odd"]: x["t"] for x in r}
    assert t[0] > 1.3 * t[1]


def test_empty_table_and_rows_handed_on(spark, rows):
    assert mixing.mix(frame(spark, [])).count() == 0
    none = mixing.mix(frame(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2
    got = mixing.mix(frame(spark, rows[:50]), rows=True)
    assert got.schema["row"].dataType.fieldNames() == ["doc_id", "source", "text", "k", "row", "size", "__key"]
    assert got.filter("row.size <> 7 or row.k <> 'k' or not (row.doc_id <=> doc_id)").count() == 0 and got.count() == 50
