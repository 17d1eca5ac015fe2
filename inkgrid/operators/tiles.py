"""Overlapping windows over pages, and the detections that each window covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import contains, filter_detections, make_box, to_page_box


def axis_windows(size: Column, crop: int = 1024, margin: int = 100, exact: bool = False) -> Column:
    """Array of (a, b, cov_a, cov_b) along one side of a page.

    The length of the last window is computed in doubles and truncated, which loses a pixel at
    many sizes; exact=True uses whole numbers instead.
    """
    cover = crop - 2 * margin
    inner = size - 2 * margin
    n = inner / F.lit(float(cover))
    whole = F.floor(n).cast("int")
    rest = (inner % cover if exact else ((n % 1) * cover)).cast("int")
    has_rest = (inner % cover > 0) if exact else (n % 1 > 0)
    sizes = F.when(n >= 1, F.concat(F.array_repeat(F.lit(cover), whole), F.when(has_rest, F.array(rest)).otherwise(F.array().cast("array<int>")))).otherwise(F.array(inner.cast("int")))
    last = F.size(sizes) - 1

    def window(s: Column, i: Column) -> Column:
        at = i * cover
        return F.struct(
            at.alias("a"),
            (at + s + 2 * margin).alias("b"),
            (at + margin - F.when(i == 0, margin).otherwise(0)).alias("cov_a"),
            (at + margin + s + F.when(i == last, margin).otherwise(0)).alias("cov_b"),
        )

    return F.transform(sizes, window)


def calc_windows(pages: DataFrame, crop: int = 1024, margin: int = 100, exact: bool = False) -> DataFrame:
    """pages (page_id, w, h): page_id, window_id (row by row), box and cover."""
    xs, ys = axis_windows(F.col("w"), crop, margin, exact), axis_windows(F.col("h"), crop, margin, exact)
    rows = pages.select("page_id", F.size(xs).alias("nx"), xs.alias("xs"), F.posexplode(ys).alias("iy", "y"))
    rows = rows.select("page_id", "nx", "iy", "y", F.posexplode("xs").alias("ix", "x"))
    x, y = F.col("x"), F.col("y")
    return rows.select(
        "page_id",
        (F.col("iy") * F.col("nx") + F.col("ix")).alias("window_id"),
        make_box(y["a"], x["a"], y["b"], x["b"]).alias("box"),
        make_box(y["cov_a"], x["cov_a"], y["cov_b"], x["cov_b"]).alias("cover"),
    )


def covered_detections(detections: DataFrame, windows: DataFrame, min_confidence: float = 0) -> DataFrame:
    """Detections (page_id, window_id, det_seq, rx1.., confidence, value) whose centre is in what their window covers, sides included."""
    joined = filter_detections(detections, min_confidence).join(windows, ["page_id", "window_id"])
    placed = to_page_box(joined).filter(contains(F.col("cover"), F.col("center_x"), F.col("center_y")))
    return placed.select("page_id", "window_id", "det_seq", "page_box", "confidence", "value")


def order_matches(matches: DataFrame) -> DataFrame:
    """matches with seq: place in the page by rising confidence, then window, then detection."""
    order = Window.partitionBy("page_id").orderBy("confidence", "window_id", "det_seq")
    return matches.withColumn("seq", F.row_number().over(order) - 1)
