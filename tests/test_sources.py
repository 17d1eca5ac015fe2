"""Listings, exports, crops and intake of many rows."""

from __future__ import annotations

import glob
import json

import numpy as np
from pyspark.sql import functions as F

from inkgrid.operators import pixels
from inkgrid.sources import images
from inkgrid.sources import tables as src
from inkgrid.streaming import tables as st


def test_files_are_listed_once_at_any_depth(spark, tmp_path, monkeypatch):
    names = ["b.png", "in/a.png", "in/b.png", "in/x.PNG", "in/deep/er/c.jpg", "in/deep/d.jpeg", "other/e.png.txt", "other/.png"]
    content = spark.createDataFrame([(n, bytearray(b"x" * k)) for k, n in enumerate(names)], "path string, content binary")
    src.write_files(content, str(tmp_path / "f"))
    src.write_files(content, str(tmp_path / "f"))  # again
    root = str(tmp_path / "f")
    for path in (root, f"file://{root}"):
        got = [(r["name"], r["path"][len(root) + 1 :], r["size"]) for r in src.list_images(spark, path).collect()]
        assert got == [(".png", "other/.png", 7), ("a.png", "in/a.png", 1), ("b.png", "b.png", 0), ("b.png", "in/b.png", 2), ("c.jpg", "in/deep/er/c.jpg", 4)]
    assert [r["name"] for r in src.list_images(spark, root, recursive=False).collect()] == ["b.png"]
    assert src.list_images(spark, root, suffixes=(".txt",)).count() == 1
    for folders in (1, 2, 3):
        monkeypatch.setattr(images, "FOLDERS", folders)
        r = images.FolderReader({"path": root})
        assert sorted(p for f in r.partitions() for p, _, _ in r.read(f)) == sorted(f"{root}/{n}" for n in names if n.endswith((".png", ".jpg")))


def test_lines_of_a_large_page_make_its_json(spark, tmp_path):
    n = 5000
    matches = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("seq"), *[F.lit(k).alias(c) for k, c in enumerate(("y1", "x1", "y2", "x2"))], (F.col("id") * 7919 % n / n).alias("confidence"), F.concat(F.lit('w"'), F.col("id").cast("string")).alias("value"))
    pages = spark.createDataFrame([(1, "big", "aa", 1), (2, "none", "bb", 1), (3, "big", "old", 0)], "page_id long, filename string, sha256 string, place int")
    lines = src.export_lines(pages, matches)
    src.write_exports(lines, str(tmp_path / "out"))
    whole = {r["filename"]: json.loads(r["json"]) for r in src.export_pages(pages, matches).collect()}
    for name in ("big", "none"):
        files = sorted(glob.glob(f"{tmp_path}/out/filename={name}/part-*"))
        assert json.loads("".join(open(f).read() for f in files)) == whole[name]
        assert name == "none" or len(files) > 1
    assert src.export_lines(pages.limit(0), matches).count() == 0


def test_an_image_moves_once_for_many_boxes(spark):
    rng = np.random.default_rng(3)
    data = {p: rng.integers(0, 255, (20, 30, 3), dtype=np.uint8) for p in (1, 2)}
    frame = spark.createDataFrame([(p, (20, 30, 3, bytearray(d.tobytes()))) for p, d in data.items()] + [(3, (1, 1, 3, bytearray(3)))], "page_id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    rows = [(1, k, *rng.integers(-5, 25, 2).tolist()) for k in range(500)] + [(2, 0, 0, 0), (9, 0, 0, 0)]
    boxes = spark.createDataFrame([(p, k, y, x, y + k % 7, x + 6) for p, k, y, x in rows], "page_id long, box_id long, y1 int, x1 int, y2 int, x2 int")
    assert pixels.images_with_boxes(frame, boxes, 100).groupBy("page_id").count().orderBy("page_id").collect() == [(1, 5), (2, 1)]
    got = {(r["page_id"], r["box_id"]): (r["height"], r["width"], bytes(r["data"])) for r in pixels.crop_pixels(frame, boxes, 100).collect()}
    assert len(got) == 501
    for p, k, y, x in rows[:-1]:
        big = np.zeros((200, 200, 3), np.uint8)
        big[50:70, 50:80] = data[p]
        want = big[50 + y : 50 + y + k % 7, 50 + x : 56 + x]
        assert got[p, k] == (k % 7, 6, want.tobytes())


def test_intake_reads_only_buckets_it_may_hit(spark, tmp_path):
    path = str(tmp_path / "labels")

    def take(first, last, run):
        folder = str(tmp_path / f"in{run}")
        spark.range(first, last).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"), F.lit("d").alias("data")).write.parquet(folder)
        st.stream_labels(spark.readStream.schema("id string, data string").parquet(folder), path, str(tmp_path / f"c{run}")).awaitTermination()

    def asked(first, last):
        new = spark.range(first, last).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"))
        return st.possible_buckets(new.withColumn("hash", F.xxhash64("id")).withColumn("bucket", F.pmod("hash", F.lit(st.BUCKETS)).cast("int")), path)[2]

    take(0, 3000, 0)
    assert asked(10**6, 10**6 + 2000) == []  # new ids: nothing but filters is read
    assert len(asked(5, 8)) <= 3  # three known ids: their buckets
    take(2000, 4000, 1)
    take(0, 4000, 2)  # all again
    got = [r["id"] for r in spark.read.parquet(path).select("id").collect()]
    assert sorted(got) == sorted(f"id{k}" for k in range(4000))
    assert len(asked(2000, 4000)) == st.BUCKETS


def test_intake_after_a_lost_filter(spark, tmp_path):
    path = str(tmp_path / "labels")
    for run in range(2):
        folder = str(tmp_path / f"in{run}")
        spark.createDataFrame([("a", "1"), ("b", "2")], "id string, data string").write.parquet(folder)
        st.stream_labels(spark.readStream.schema("id string, data string").parquet(folder), path, str(tmp_path / f"c{run}")).awaitTermination()
        for f in glob.glob(f"{path}__filters/bucket=*/*.parquet"):
            spark.createDataFrame([], "bits binary").write.mode("overwrite").parquet(f.rpartition("/")[0])
    assert spark.read.parquet(path).count() == 2


def test_flow_to_files_at_two_sizes(spark):
    """One page of 2,000 by 1,500, read as it is and at half its size; a page without matches has a file, too."""
    from inkgrid.operators import ocr

    pages = spark.createDataFrame([(1, "a.png", "s1", 2000, 1500, 1), (2, "b.png", "s2", 300, 300, 1)], "page_id long, filename string, sha256 string, w int, h int, place int")
    columns = "page_id long, window_id int, det_seq int, rx1 double, ry1 double, rx2 double, ry2 double, confidence double, value string"
    found = spark.createDataFrame([(1, 0, 0, 0.4, 0.4, 0.6, 0.6, 0.9, "late"), (1, 0, 1, 0.1, 0.1, 0.2, 0.2, 0.5, "soon"), (1, 0, 2, 0.1, 0.1, 0.2, 0.2, 0.1, "faint")], columns)

    def files(ratio):
        out = {}
        for r in sorted(ocr.page_exports(pages, found, ratio, 0.25).collect(), key=lambda r: (r["filename"], r["line"])):
            out[r["filename"]] = out.get(r["filename"], "") + r["json"]
        return {k: json.loads(v) for k, v in out.items()}

    for ratio, (w, h) in ((None, (1024, 1024)), (0, (1024, 1024)), (0.5, (1000, 750))):
        got = files(ratio)
        assert got["b.png"] == {"filename": "b.png", "sha256": "s2", "matches": []} and got["a.png"]["sha256"] == "s1"
        assert [m["value"] for m in got["a.png"]["matches"]] == ["soon", "late"]
        assert got["a.png"]["matches"][1]["bbox"] == [int(0.4 * h), int(0.4 * w), int(0.6 * h), int(0.6 * w)]
