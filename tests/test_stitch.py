"""Stitching of irregular pages against the rule in plain loops, and of one dense page in time that grows with its words."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import stitch


def gap(a1, a2, b1, b2):
    return max(0, b1 - a2, a1 - b2)


def lines_near(base, around, c):
    h = base[2] - base[0]
    middle = lambda b: b[0] + (b[2] - b[0]) / 2
    return abs(middle(base) - middle(c)) <= h * 0.25 and gap(around[1], around[3], c[1], c[3]) <= h * 0.5


def blocks_near(base, around, c):
    h = base[2] - base[0]
    return gap(around[0], around[2], c[0], c[2]) <= h * 0.5 and gap(around[1], around[3], c[1], c[3]) <= h * 0.5


def grown(boxes, near):
    """Group number and place of each box: the last one left starts a group, which takes in what is near, round by round."""
    left, out, number = list(range(len(boxes))), {}, 0
    while left:
        base = left.pop()
        group, around = [base], boxes[base]
        while True:
            hit = [k for k in left if near(boxes[base], around, boxes[k])]
            if not hit:
                break
            group += hit
            left = [k for k in left if k not in set(hit)]
            all_of = [boxes[k] for k in group]
            around = (min(b[0] for b in all_of), min(b[1] for b in all_of), max(b[2] for b in all_of), max(b[3] for b in all_of))
        out |= {k: (number, place) for place, k in enumerate(group)}
        number += 1
    return [out[k] for k in range(len(boxes))]


def page(kind, seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 120)
    if kind == "scattered":
        at = [(rng.randrange(400), rng.randrange(300), rng.randrange(1, 30), rng.randrange(1, 60)) for _ in range(n)]
    elif kind == "columns":
        at = [(14 * (k // 2) + rng.randrange(4), 150 * (k % 2) + rng.randrange(9), 10 + rng.randrange(5), rng.randrange(30, 130)) for k in range(n)]
    elif kind == "giants":
        at = [(rng.randrange(2000), rng.randrange(2000), *((rng.randrange(300, 900),) * 2 if rng.random() < 0.1 else (8, 20))) for _ in range(n)]
    else:  # touching, nested and flat boxes
        at = [(10 * rng.randrange(8), 10 * rng.randrange(8), rng.choice([0, 10, 20]), rng.choice([0, 10, 40])) for _ in range(n)]
    return [(y, x, y + h, x + w) for y, x, h, w in at]


KINDS = ["scattered", "columns", "giants", "touching"]


@pytest.mark.parametrize("part_rows", [5, 200])
def test_irregular_pages(spark, part_rows):
    pages = {k: page(KINDS[k % 4], k) for k in range(48)}
    rows = [(k, i, *b, 0.5, f"w{i}") for k, bs in pages.items() for i, b in enumerate(bs)]
    rows.append((None, 0, 1, 1, 9, 9, 0.5, "no page"))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "page_id int, seq int, y1 int, x1 int, y2 int, x2 int, confidence double, value string")
    for stitched, name, near in ((stitch.stitch_lines(df, part_rows=part_rows), "line_seq", lines_near), (stitch.stitch_blocks(df.withColumnRenamed("seq", "line_seq"), part_rows=part_rows), "block_seq", blocks_near)):
        got = {}
        for r in stitched.collect():
            got.setdefault(r["page_id"], {})[r["seq" if name == "line_seq" else "line_seq"]] = (r[name], r["add_order"])
        assert got.pop(None) == {0: (0, 0)}
        for k, bs in pages.items():
            assert [got[k][i] for i in range(len(bs))] == grown(bs, near), (KINDS[k % 4], k)


def test_a_dense_page_takes_time_in_proportion():
    """Words without gaps in y: ten times the words on a page ten times as long take about ten times as long."""
    seconds = []
    for n in (4000, 40000):
        rng = np.random.default_rng(1)
        y, x = rng.integers(0, n // 4, n), rng.integers(0, 3000, n)
        box = np.stack((y, x, y + 20, x + rng.integers(10, 80, n)), axis=1).astype(float)
        middles = box[:, 0] + 10

        def near(base, around, c):
            return (abs(middles[base] - (c[0] + 10)) <= 5) & (c[1] - around[3] <= 10) & (around[1] - c[3] <= 10)

        began = time.process_time()
        group, place = stitch.grow_groups(box, middles, middles, lambda base, around: (middles[base] - 5, middles[base] + 5), near)
        seconds.append(time.process_time() - began)
        assert len(set(zip(group.tolist(), place.tolist()))) == n
    assert seconds[1] < 30 * seconds[0]


def test_one_page_with_most_rows_is_spread(spark):
    rows = [(1, i, 30 * i, 0, 30 * i + 10, 50, 0.5, "x") for i in range(3000)] + [(2, 0, 0, 0, 10, 50, 0.5, "y")]
    df = spark.createDataFrame(rows, "page_id int, seq int, y1 int, x1 int, y2 int, x2 int, confidence double, value string")
    parts = stitch._parts(df, F.col("y1"), F.col("y2"), 0.5, 50).groupBy("page_id", "__part").count().collect()
    assert len(parts) == 61 and max(r["count"] for r in parts) == 50
    got = {r["seq"]: r["line_seq"] for r in stitch.stitch_lines(df).filter("page_id = 1").collect()}
    assert got == {i: 2999 - i for i in range(3000)}
    assert stitch.stitch_blocks(df.withColumnRenamed("seq", "line_seq").limit(0)).count() == 0
