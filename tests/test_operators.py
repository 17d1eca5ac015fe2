"""Small cases worked by hand, and properties."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions import boxes as bx
from inkgrid.functions import text as tx
from inkgrid.operators import draw, labels, pixels, prefix, runlog, score, stitch, tiles, vocab
from inkgrid.plans import pages as pg
from inkgrid.sources import tables as src
from inkgrid.streaming import tables as st


def axis(dim, crop=1024, margin=100):
    """Along one side, straight from the rule."""
    cover = crop - 2 * margin
    n = (dim - 2 * margin) / cover
    sizes = [cover] * int(n) + ([int(n % 1 * cover)] if n % 1 > 0 else []) if n >= 1 else [dim - 2 * margin]
    out, at = [], 0
    for i, s in enumerate(sizes):
        out.append((at, at + s + 2 * margin, at + margin - margin * (i == 0), at + margin + s + margin * (i == len(sizes) - 1)))
        at += s
    return out


def test_windows_at_edge_sizes(spark):
    dims = [1, 199, 200, 1023, 1024, 1025, 1028, 1848, 5000, *range(1030, 6000, 37)]
    got = spark.createDataFrame([(d,) for d in dims], "d int").select("d", tiles.axis_windows(F.col("d")).alias("w")).collect()
    assert {r["d"]: [tuple(x) for x in r["w"]] for r in got} == {d: axis(d) for d in dims}


def test_words_split_at_unicode_spaces(spark):
    text = "a b　c d\x1ce\n\tf g "
    row = spark.createDataFrame([(text,), (None,)], "t string").select(tx.words(F.col("t")).alias("w")).collect()
    assert row[0]["w"] == text.split() and row[1]["w"] == []


def test_punctuation_modes_and_alphabet(spark):
    w = spark.createDataFrame([("a.b",), (tx.PUNCTUATION + "x",), ("",)], "w string")
    got = w.select(tx.strip_punctuation(F.col("w")), tx.strip_punctuation(F.col("w"), "charclass"), tx.in_alphabet(F.col("w"), "ab")).collect()
    assert [tuple(r) for r in got] == [("a.b", "ab", False), ("x", "x", False), ("", "", False)]


def test_floor_and_small_vocabulary(spark):
    v = spark.createDataFrame([("a", 5), ("word", 7)], "id string, count long")
    floored = {r["id"]: r["count"] for r in vocab.apply_floor(v, 1000, 10, "가나").collect()}
    assert floored["a"] == 1000 and floored["word"] == 7 and floored["가"] == 10 and len(floored) == 62 + 2 + 1
    assert {r["id"]: r["count"] for r in vocab.apply_floor(v, 0, 0).collect()} == {"a": 5, "word": 7}
    capped = vocab.cap_frequency(v)
    assert [r["weight"] for r in capped.collect()] == [0, 0]
    assert vocab.cap_report(capped).first()["share"] is None


def test_running_sum_and_split_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("w"))
    for n in (1, 8):
        got = prefix.running_sum(df.repartition(n), ["id"], "w").orderBy("id").collect()
        assert [r["running"] for r in got] == np.cumsum([i % 7 for i in range(1000)]).tolist()
    split = lambda n: {r["id"]: r["split"] for r in prefix.split_labels(df.repartition(n), 0.1, "s").collect()}
    assert split(1) == split(8) and list(split(1).values()).count("train") == int((1 - 0.1) * 1000)


def test_sticky_split_keeps_sides(spark):
    now = spark.createDataFrame([(f"k{i}",) for i in range(40)], "id string")
    old = spark.createDataFrame([("k0", "val"), ("k1", "train"), ("k1", "val"), ("gone", "train")], "id string, split string")
    got = [(r["id"], r["split"]) for r in prefix.sticky_split(now, old).collect()]
    assert ("k0", "val") in got and ("k1", "train") in got and ("k1", "val") in got and "gone" not in dict(got) and len(got) == 41


def test_weighted_draw_never_draws_zero_weights(spark):
    v = spark.createDataFrame([("a", 0), ("b", 3), ("c", 1)], "id string, weight long")
    got = draw.weighted_draw(v, spark.range(2000), F.col("id").cast("string"))
    n = {r["drawn"]: r["count"] for r in got.groupBy("drawn").count().collect()}
    assert set(n) == {"b", "c"} and 1350 < n["b"] < 1650 and sum(n.values()) == 2000
    assert draw.percent_counts(0.8, 0.1) == {"image": 80, "fill": 10, "none": 9}
    assert draw.percent_counts(0.6, 0.2) == {"image": 60, "fill": 20, "none": 19}


def test_seam_is_kept_by_both_windows(spark):
    pages = spark.createDataFrame([(1, 2000, 500)], "page_id long, w int, h int")
    w = tiles.calc_windows(pages)
    seam = w.filter("window_id = 0").first()["cover"]["x2"]
    dets = []
    for r in w.filter("window_id < 2").collect():
        b = r["box"]
        x = (seam - b["x1"]) / (b["x2"] - b["x1"])
        dets.append((1, r["window_id"], 0, x - 0.01, 0.4, x + 0.01, 0.5, 0.5, "v"))
    dets.append((1, 0, 1, 0.1, 0.1, 0.2, 0.2, 0.9, ""))
    d = spark.createDataFrame(dets, "page_id long, window_id int, det_seq int, rx1 double, ry1 double, rx2 double, ry2 double, confidence double, value string")
    assert sorted(r["window_id"] for r in tiles.covered_detections(d, w).collect()) == [0, 1]


def slow_groups(boxes, near):
    left, out = list(range(len(boxes))), []
    while left:
        base = left.pop()
        group = [base]
        while True:
            around = (min(boxes[i][0] for i in group), min(boxes[i][1] for i in group), max(boxes[i][2] for i in group), max(boxes[i][3] for i in group))
            new = [i for i in left if near(boxes[base], around, boxes[i])]
            if not new:
                break
            group += new
            left = [i for i in left if i not in new]
        out.append(sorted(group))
    return out


def test_line_growth_matches_the_plain_rule(spark):
    rng = np.random.default_rng(1)
    boxes = [(int(y), int(x), int(y + h), int(x + w)) for y, x, h, w in zip(rng.integers(0, 60, 80), rng.integers(0, 400, 80), rng.integers(5, 25, 80), rng.integers(5, 40, 80))]

    def near(b, a, m):
        h = b[2] - b[0]
        return abs((b[0] + h / 2) - (m[0] + (m[2] - m[0]) / 2)) <= h * 0.25 and max(0, m[1] - a[3], a[1] - m[3]) <= h * 0.5

    df = spark.createDataFrame([(1, i, *b, float(i), f"w{i}") for i, b in enumerate(boxes)], "page_id long, seq int, y1 int, x1 int, y2 int, x2 int, confidence double, value string")
    got: dict = {}
    for r in stitch.stitch_lines(df).collect():
        got.setdefault(r["line_seq"], []).append(r["seq"])
    assert [sorted(got[k]) for k in sorted(got)] == slow_groups(boxes, near)


def test_the_flow_from_detections_to_blocks_matches_loops(spark, sf_dir):
    from inkgrid import queries
    from inkgrid.plans import fixtures

    rows = tiles.covered_detections(fixtures.detections(spark, sf_dir), tiles.calc_windows(fixtures.page_sizes(spark, sf_dir)), 0.25).collect()
    pages: dict = {}
    for r in sorted(rows, key=lambda r: (r["confidence"], r["window_id"], r["det_seq"])):
        pages.setdefault(r["page_id"], []).append((tuple(r["page_box"][c] for c in ("y1", "x1", "y2", "x2")), r["value"]))

    def around(boxes):
        return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)

    def in_line(b, a, m):
        h = b[2] - b[0]
        return abs((b[0] + h / 2) - (m[0] + (m[2] - m[0]) / 2)) <= h * 0.25 and max(0, m[1] - a[3], a[1] - m[3]) <= h * 0.5

    def in_block(b, a, m):
        h = b[2] - b[0]
        return max(0, m[0] - a[2], a[0] - m[2]) <= h * 0.5 and max(0, m[1] - a[3], a[1] - m[3]) <= h * 0.5

    want = set()
    for page, found in pages.items():
        boxes = [b for b, _ in found]
        groups = slow_groups(boxes, in_line)
        lines = [around([boxes[i] for i in g]) for g in groups]
        words = [sorted(found[i][1] for i in g) for g in groups]
        for g in slow_groups(lines, in_block):
            want.add((page, *around([lines[i] for i in g]), len(g), tuple(sorted(w for i in g for w in words[i]))))
    got = {(r["page_id"], r["y1"], r["x1"], r["y2"], r["x2"], r["n"], tuple(sorted(r["value"].split()))) for r in queries.QUERIES["ocr_page_blocks"](spark, sf_dir).collect()}
    assert got == want and len(got) > 100


def test_chains_of_boxes_are_paired_best(spark, sf_dir):
    from inkgrid import queries
    from inkgrid.plans import fixtures

    gt = fixtures.boxes_gt(spark, sf_dir).withColumns({c: F.col(c) / 2 for c in ("x1", "x2")})
    groups: dict = {}
    for r in score.iou_pairs(gt, fixtures.boxes_between(spark, sf_dir)).collect():
        groups.setdefault((r["image_id"], r["class"]), {})[r["gt_id"], r["pred_id"]] = r["iou"]

    def best(pairs):
        """The largest total of a pairing, leaving the first box free or trying each of its pairs."""
        if not pairs:
            return 0.0
        g = min(a for a, _ in pairs)
        rest = {k: v for k, v in pairs.items() if k[0] != g}
        return max([best(rest), *(v + best({k: w for k, w in rest.items() if k[1] != p}) for (a, p), v in pairs.items() if a == g)])

    got = queries.QUERIES["g5_pair_chains"](spark, sf_dir).collect()
    total: dict = {}
    for r in got:
        total[r["image_id"], r["class"]] = total.get((r["image_id"], r["class"]), 0.0) + r["iou"]
    contested = sum(len(p) > len({a for a, _ in p}) for p in groups.values())
    assert contested and len({(r["image_id"], r["class"], r["gt_id"]) for r in got}) == len({(r["image_id"], r["class"], r["pred_id"]) for r in got}) == len(got)
    for k, pairs in groups.items():
        assert abs(total.get(k, 0.0) - best(pairs)) < 1e-6


def test_a_large_page_is_stitched_in_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(1, i, int(y), int(x), int(y + 4 + i % 9), int(x + 20), 1.0, f"w{i}") for i, (y, x) in enumerate(zip(rng.integers(0, 4000, 300), rng.integers(0, 300, 300)))]
    df = spark.createDataFrame(rows, "page_id long, seq int, y1 int, x1 int, y2 int, x2 int, confidence double, value string")
    for stitched, boxes in ((stitch.stitch_lines, df), (stitch.stitch_blocks, df.withColumnRenamed("seq", "line_seq"))):
        assert sorted(map(tuple, stitched(boxes, part_rows=10).collect())) == sorted(map(tuple, stitched(boxes, part_rows=10**6).collect()))
    parts = stitch._parts(df, F.col("y1"), F.col("y2"), 0.5, 10).groupBy("__part").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 60


def test_pairing_goes_by_component(spark):
    rng = np.random.default_rng(8)
    rows = [("i", "c", 10 * k + int(g), 10 * k + int(p), float(rng.random())) for k in range(40) for g, p in {tuple(x) for x in rng.integers(0, 3, (1 + k % 5, 2)).tolist()}]
    pairs = spark.createDataFrame(rows, "image_id string, class string, gt_id long, pred_id long, iou double")
    out = score.pair_boxes(pairs)
    got = out.collect()
    assert len({r["gt_id"] for r in got}) == len({r["pred_id"] for r in got}) == len(got)
    best = 0.0
    for k in range(40):
        w = {(r[2] % 10, r[3] % 10): r[4] for r in rows if r[2] // 10 == k}
        best += max(sum(w.get((i, j), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(3)))
    assert abs(sum(r["iou"] for r in got) - best) < 1e-9


def test_a_long_run_is_smoothed_in_blocks(spark):
    rng = np.random.default_rng(9)
    runs = {1: rng.random(3), 2: rng.random(4000), 3: rng.random(1)}
    expected, log = {}, []
    for run, losses in runs.items():
        mean = 0.0
        for e, x in enumerate(losses.tolist()):
            mean = 0.95 * mean + 0.05 * x
            expected[run, e] = mean / (1 - 0.95 ** (e + 1))
            log.append((run, e, x))
    out = runlog.smoothed_loss(spark.createDataFrame(log, "run_id long, epoch int, val_loss double").repartition(3))
    got = {(r["run_id"], r["epoch"]): r["smoothed"] for r in out.collect()}
    assert set(got) == set(expected) and max(abs(got[k] - expected[k]) for k in got) < 1e-9
    assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()


def test_metrics_without_boxes(spark):
    none = spark.createDataFrame([], "image_id long, class string, box_id long, y1 int, x1 int, y2 int, x2 int")
    r = score.localization_metrics(none, none).first()
    assert (r["n_gt"], r["matches"], r["recall"], r["precision"], r["mean_iou"]) == (0, 0, None, None, None)


def test_early_stop_follows_the_counter(spark):
    rng = np.random.default_rng(3)
    runs = {k: rng.random(60).round(2).tolist() for k in range(12)}

    def stop(losses, patience=5, delta=0.01):
        best, n = float("inf"), 0
        for i, x in enumerate(losses):
            if x < best:
                best, n = x, 0
            elif x > best + delta:
                n += 1
                if n >= patience:
                    return i
        return None

    log = spark.createDataFrame([(k, i, x) for k, v in runs.items() for i, x in enumerate(v)], "run_id long, epoch int, val_loss double")
    assert {r["run_id"]: r["stop_epoch"] for r in runlog.early_stop(log).collect()} == {k: stop(v) for k, v in runs.items()}


def test_plans_are_disjoint_inside_and_repeatable(spark):
    ids = spark.range(6).select(F.col("id").alias("page_id"))

    def plan(n):
        pages = pg.plan_pages(ids.repartition(n), "t")
        return pages, pg.plan_panels(pages, "t", 12)

    pages, panels = plan(1)
    again = plan(8)[1]
    assert sorted(map(tuple, panels.collect())) == sorted(map(tuple, again.collect()))
    size = {r["page_id"]: (r["w"], r["h"]) for r in pages.collect()}
    bubbles = pg.plan_bubbles(panels, ["f"], "t", 4)
    for rows, keys in ((panels.collect(), ["page_id"]), (bubbles.collect(), ["page_id", "panel_id"])):
        for r in rows:
            assert 0 <= r["x1"] < r["x2"] <= size[r["page_id"]][0] and 0 <= r["y1"] < r["y2"] <= size[r["page_id"]][1]
        for a, b in itertools.combinations(rows, 2):
            if all(a[k] == b[k] for k in keys):
                assert a["x2"] <= b["x1"] or b["x2"] <= a["x1"] or a["y2"] <= b["y1"] or b["y2"] <= a["y1"]


def test_page_plans_have_the_tries_of_the_reference(spark, sf_dir):
    import inspect

    from inkgrid import queries as own

    assert [inspect.signature(f).parameters["tries"].default for f in (pg.plan_panels, pg.plan_bubbles, pg.plan_texts)] == [50, 10, 500]
    plan = own.QUERIES["p5_plan_texts"](spark, sf_dir).agg(*[F.max(f"{c}_id") for c in ("panel", "bubble", "text")]).first()
    assert plan[0] >= 20 and plan[1] >= 4 and plan[2] >= 400


def test_packing_of_cells_matches_the_plain_rule(spark):
    rng = np.random.default_rng(5)
    sizes = [(p, t, r, c, int(rng.integers(1, c + 1)), int(rng.integers(1, r + 1))) for p, (r, c) in enumerate([(3, 12), (12, 3), (7, 8), (1, 1)]) for t in range(30)]
    expected = set()
    for p in range(4):
        used: set = set()
        for _, t, r, c, w, h in [s for s in sizes if s[0] == p]:
            spots = ({(i, j) for i in range(x, x + w) for j in range(y, y + h)} for x in range(r) for y in range(c) if x + w <= c and y + h <= r)
            spot = next((s for s in spots if not s & used), None)
            if spot:
                used |= spot
                expected.add((p, t, *min(spot)))
    df = spark.createDataFrame(sizes, "page_id long, try_id int, n_rows int, n_cols int, w int, h int")
    assert {(r["page_id"], r["try_id"], r["x"], r["y"]) for r in stitch.pack_rects(df).collect()} == expected


def test_image_list_and_catalogue(spark, tmp_path):
    for name in ("b.png", "a.jpg", "c.PNG", "d.jpeg", "e.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"y")
    found = src.list_images(spark, str(tmp_path))
    assert [r["name"] for r in found.collect()] == ["a.jpg", "a.jpg", "b.png"]
    assert src.list_images(spark, str(tmp_path), recursive=False).count() == 2
    last = src.catalog_by_basename(found, [F.col("path")]).filter("name = 'a.jpg'").first()["path"]
    assert last.endswith("in/a.jpg")


def test_crops_beyond_the_image_are_zero(spark):
    data = bytes(range(12))
    images = spark.createDataFrame([(1, (3, 4, 1, data))], "page_id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    boxes = spark.createDataFrame([(1, 1, 1, 2, 3, 6)], "page_id long, box_id long, y1 int, x1 int, y2 int, x2 int")
    r = pixels.crop_pixels(images, boxes).first()
    assert (r["height"], r["width"], list(r["data"])) == (2, 4, [6, 7, 0, 0, 10, 11, 0, 0])


def test_label_intake_by_stream_is_idempotent(spark, tmp_path):
    rows = [("a", "1"), ("a", "2"), ("b", None), (None, "3"), ("c", "4")]
    spark.createDataFrame(rows, "id string, data string").write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("id string, data string").parquet(str(tmp_path / "in"))
        st.stream_labels(stream, str(tmp_path / "out"), str(tmp_path / f"check{k}")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "data").collect())) == [("a", "1"), ("c", "4")]


def test_nesting_keeps_childless_parents(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    panels = spark.createDataFrame([(1, 1)], "page_id long, panel_id int")
    bubbles = spark.createDataFrame([(1, 1, 1)], "page_id long, panel_id int, bubble_id int")
    texts = spark.createDataFrame([(1, 1, 1, 1, "w")], "page_id long, panel_id int, bubble_id int, text_id int, word string")
    got = {r["page_id"]: r["panels"] for r in labels.nest_layout(pages, panels, bubbles, texts).collect()}
    assert got[2] == [] and got[1][0]["bubbles"][0]["texts"][0]["word"] == "w"


@pytest.mark.parametrize("size", [1, 3, 7])
def test_batches(spark, size):
    df = spark.range(20)
    kept = prefix.assign_batches(df, size).groupBy("batch").count().collect()
    assert sum(r["count"] for r in kept) == 20 and len(kept) == -(-20 // size)
    whole = prefix.assign_batches(df, size, shuffle=True, drop_last=True).groupBy("batch").count().collect()
    assert len(whole) == 20 // size and {r["count"] for r in whole} == {size}


def test_box_columns_pass_nulls(spark):
    df = spark.createDataFrame([(None,)], "box struct<y1:int,x1:int,y2:int,x2:int>")
    assert bx.box_measures(df).first()["width"] is None
