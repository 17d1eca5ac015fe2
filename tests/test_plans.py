"""Plans of words: every try is looked at, by the rule, and tries are not rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkgrid.functions.text import mixed
from inkgrid.operators import stitch
from inkgrid.plans import pages as pg


def test_first_disjoint_matches_the_loop():
    rng = np.random.default_rng(4)
    group = np.sort(rng.integers(0, 20, 2000))
    y, x = rng.integers(0, 100, 2000), rng.integers(0, 100, 2000)
    box = np.stack((y, x, y + rng.integers(1, 30, 2000), x + rng.integers(1, 30, 2000)), axis=1)
    want: list[int] = []
    for i, b in enumerate(box.tolist()):
        if not any(group[k] == group[i] and box[k][1] < b[3] and b[1] < box[k][3] and box[k][0] < b[2] and b[0] < box[k][2] for k in want):
            want.append(i)
    assert stitch.first_disjoint(group, box).tolist() == want
    assert len(stitch.first_disjoint(group[:0], box[:0])) == 0


def test_draws_are_even():
    u = np.stack([mixed(np.arange(200, dtype=np.int64).repeat(500), np.tile(np.arange(500), 200), k) for k in range(9)])
    assert (0 <= u).all() and (u < 1).all() and abs(u.mean(axis=1) - 0.5).max() < 0.01
    assert abs(np.corrcoef(u) - np.eye(9)).max() < 0.02


def test_words_fit_and_tries_are_no_rows(spark):
    bubbles = spark.createDataFrame([(1, k, 0, 10 * k, 5, 10 * k + 90 + 40 * k, 200 + 60 * k, "f") for k in range(8)] + [(2, 0, 0, 0, 0, 19, 500, "f")], "page_id int, panel_id int, bubble_id int, y1 int, x1 int, y2 int, x2 int, font string")
    vocab = spark.createDataFrame([("a", 5), ("bc", 3), ("zz", 2), ("long", 1), ("never", 0)], "id string, weight long")
    out = pg.plan_texts(bubbles, vocab, "t")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # the vocabulary's buckets
    rows = out.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pg.plan_texts(bubbles.repartition(5), vocab, "t").collect()))
    side = {(r["page_id"], r["panel_id"]): r for r in bubbles.collect()}
    for r in rows:
        b = side[r["page_id"], r["panel_id"]]
        assert b["y1"] <= r["y1"] < r["y2"] <= b["y2"] and b["x1"] <= r["x1"] < r["x2"] <= b["x2"]
        assert r["x2"] - r["x1"] >= r["font_size"] * len(r["word"]) and 20 <= r["font_size"] <= 50 and -20 <= r["angle"] <= 20
    assert {r["word"] for r in rows} == {"a", "bc", "zz", "long"} and max(r["text_id"] for r in rows) > 300 and {r["page_id"] for r in rows} == {1}
    for a in rows:
        assert not any(a is not b and a["panel_id"] == b["panel_id"] and a["x1"] < b["x2"] and b["x1"] < a["x2"] and a["y1"] < b["y2"] and b["y1"] < a["y2"] for b in rows)
    assert pg.plan_texts(bubbles, vocab.filter("weight = 0"), "t").count() == 0
    assert pg.plan_texts(bubbles, vocab.withColumn("weight", F.lit(1)), "t", tries=1).count() <= 8
