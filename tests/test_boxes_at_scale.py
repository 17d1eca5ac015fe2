"""Grid joins, keep-first by rounds and pairing by rounds against loops over all boxes."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import graph, grid, score, stitch

BOX = "y1 double, x1 double, y2 double, x2 double"


def meet(a, b):
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def boxes(rng, n, side, big=0.02):
    out = []
    for _ in range(n):
        y, x = rng.uniform(-side, side), rng.uniform(-side, side)
        h, w = (rng.uniform(0, 8), rng.uniform(0, 30)) if rng.random() > big else (rng.uniform(0, side), rng.uniform(0, side))
        out.append((y, x, y + h, x + w))
    return out


@pytest.mark.parametrize("side", [1, 60, 400])
def test_meetings_of_mixed_sizes(spark, side):
    rng = random.Random(side)
    rows = [(k, i, *b) for k in "ab" for i, b in enumerate([*boxes(rng, 120, side), (5.0, 5.0, 5.0, 9.0), (3.0, 3.0, 3.0, 3.0), (0.0, 0.0, 10.0, 10.0)])]
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 1.0, 1.0), ("a", 999, None, 0.0, 1.0, 1.0)], f"k string, id int, {BOX}")
    got = [tuple(r) for r in grid.meetings(df, None, ["k"]).filter("l.id < r.id").select("l.k", F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
    want = [(p[0], p[1], q[1]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and meet(p[2:], q[2:])]
    assert sorted(got) == sorted(want)


def test_a_crowded_band_gives_few_rows(spark):
    """Ten thousand words in one line of a page: each meets its neighbours only, and no cell has more than a few."""
    row = spark.range(10000).select(F.lit("p").alias("k"), F.col("id"), F.lit(0.0).alias("y1"), (F.col("id") * 9.0).alias("x1"), F.lit(10.0).alias("y2"), (F.col("id") * 9.0 + 10).alias("x2"))
    sizes = grid._sizes([row], ["k"])
    cells = grid.celled(row, sizes, ["k"])
    assert cells.count() <= 4 * 10000
    assert cells.groupBy("k", "__cy", "__cx").count().agg(F.max("count")).first()[0] <= 4
    assert grid.meetings(row, None, ["k"]).filter("l.id < r.id").count() == 9999


def test_cells_are_bounded_with_giants(spark):
    rng = random.Random(3)
    rows = [(1, *b) for b in boxes(rng, 3000, 10**6, 0.05)]
    df = spark.createDataFrame(rows, f"k int, {BOX}")
    assert grid.celled(df, grid._sizes([df], ["k"]), ["k"]).count() <= 5 * len(rows)


def greedy(found):
    kept = []
    for i, b in found:
        if not any(meet(b, c) for _, c in kept):
            kept.append((i, b))
    return {i for i, _ in kept}


def test_keep_first_matches_the_loop(spark):
    rng = random.Random(7)
    groups = {"one": boxes(rng, 400, 60), "two": boxes(rng, 60, 400), None: boxes(rng, 50, 20), "copies": [(0.0, 0.0, 5.0, 5.0)] * 40, "touch": [(0.0, 5.0 * k, 5.0, 5.0 * k + 5) for k in range(20)]}
    rows = [(g, i, *b, "x") for g, bs in groups.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), f"g string, n int, {BOX}, extra string")
    out = stitch.keep_first_disjoint(df, ["g"], "n")
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], set()).add(r["n"])
    assert got == {g: greedy(list(enumerate(bs))) for g, bs in groups.items()}
    assert stitch.keep_first_disjoint(df.limit(0), ["g"], "n").count() == 0


def test_one_large_group_is_done_in_rounds(spark):
    """Twenty thousand boxes of one group, against the loop with a grid of its own."""
    rng = np.random.default_rng(5)
    at = rng.integers(0, 1500, (20000, 2)).tolist()
    df = spark.createDataFrame([(1, i, y, x, y + 10, x + 10) for i, (y, x) in enumerate(at)], "g int, n int, y1 int, x1 int, y2 int, x2 int")
    cells, want = {}, set()
    for i, (y, x) in enumerate(at):
        near = [p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells.get((y // 10 + a, x // 10 + b), [])]
        if all(abs(y - v) >= 10 or abs(x - w) >= 10 for v, w in near):
            want.add(i)
            cells.setdefault((y // 10, x // 10), []).append((y, x))
    assert {r["n"] for r in stitch.keep_first_disjoint(df, ["g"], "n").select("n").collect()} == want
    links = grid.meetings(df, None, ["g"]).filter("l.n < r.n").select(F.col("l.n").alias("a"), F.col("r.n").alias("b"))
    rounds = graph.not_independent(links).agg(F.max("round")).first()[0]
    assert 3 <= rounds <= 30


def best_total(edges):
    """By trying all subsets of partners, left node after left node."""
    left = sorted({e[0] for e in edges})

    def go(k, used):
        if k == len(left):
            return 0.0
        return max([go(k + 1, used), *(w + go(k + 1, used | {j}) for i, j, w in edges if i == left[k] and j not in used)])

    return go(0, frozenset())


def test_matcher_is_optimal():
    rng = random.Random(4)
    for n in range(300):
        pairs = {(rng.randrange(5), rng.randrange(6)) for _ in range(rng.randrange(1, 14))}
        edges = [(i, j, rng.choice([rng.random(), 0.5, 0.25])) for i, j in sorted(pairs)]
        l, r = (np.unique([e[k] for e in edges], return_inverse=True)[1].tolist() for k in (0, 1))
        chosen = [e for e, c in zip(edges, score.assign(l, r, [e[2] for e in edges])) if c]
        assert len({e[0] for e in chosen}) == len({e[1] for e in chosen}) == len(chosen)
        assert sum(e[2] for e in chosen) == pytest.approx(best_total(edges))


def test_pairing_of_stars_chains_and_rings(spark):
    rng = random.Random(6)
    groups = []
    for k in range(60):
        kind, n = k % 4, 2 + k % 5
        if kind == 0:
            e = [(0, j) for j in range(n)]
        elif kind == 1:
            e = [(i, j) for i in range(n) for j in (i, i + 1)]
        elif kind == 2:
            e = [(i, j) for i in range(n) for j in (i, (i + 1) % n)]
        else:
            e = [(rng.randrange(4), rng.randrange(4)) for _ in range(8)]
        same = rng.random() < 0.3
        groups.append([(i, j, 0.5 if same else rng.random()) for i, j in sorted(set(e))])
    rows = [("i", f"c{k % 3}", 100 * k + i, 100 * k + j, w) for k, es in enumerate(groups) for i, j, w in es]
    pairs = spark.createDataFrame(rows, "image_id string, class string, gt_id long, pred_id long, iou double")
    got = score.pair_boxes(pairs).collect()
    assert set(map(tuple, got)) <= set(rows) and len({r["gt_id"] for r in got}) == len({r["pred_id"] for r in got}) == len(got)
    assert sum(r["iou"] for r in got) == pytest.approx(sum(map(best_total, groups)))
    assert score.pair_boxes(pairs.limit(0)).count() == 0


def test_one_long_chain(spark):
    """Ten thousand boxes in one component, against dynamic programming along the chain."""
    rng = random.Random(2)
    w = [round(rng.uniform(0.1, 0.9), 6) for _ in range(20000)]
    pairs = spark.createDataFrame([("i", "c", (k + 1) // 2, k // 2, x) for k, x in enumerate(w)], "image_id string, class string, gt_id long, pred_id long, iou double")
    take, leave = 0.0, 0.0
    for x in w:
        take, leave = leave + x, max(leave, take)
    got = score.pair_boxes(pairs).collect()
    assert len({r["gt_id"] for r in got}) == len({r["pred_id"] for r in got}) == len(got)
    assert sum(r["iou"] for r in got) == pytest.approx(max(take, leave))
