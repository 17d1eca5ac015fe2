"""Boxes, polygons, detections and colours as columns.

A box is a struct of whole numbers (y1, x1, y2, x2); a polygon is an array of (x, y).
Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_box(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in (("y1", y1), ("x1", x1), ("y2", y2), ("x2", x2))])


def poly_bbox(poly: Column) -> Column:
    """The box around a polygon."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return make_box(F.array_min(ys), F.array_min(xs), F.array_max(ys), F.array_max(xs))


def box_measures(df: DataFrame, box: str = "box") -> DataFrame:
    """df with width, height, center_x and center_y."""
    b = F.col(box)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return df.withColumns({"width": w, "height": h, "center_x": b["x1"] + w / 2, "center_y": b["y1"] + h / 2})


def label_box(box: Column, width: Column, height: Column) -> Column:
    """The box grown by a pixel and clamped to the image."""
    return make_box(
        F.greatest(box["y1"] - 1, F.lit(0)), F.greatest(box["x1"] - 1, F.lit(0)), F.least(box["y2"] + 1, height - 1), F.least(box["x2"] + 1, width - 1)
    )


def box_polygon(box: Column) -> Column:
    """The corners (x1, y1), (x1, y2), (x2, y2), (x2, y1)."""
    return F.array(*[F.array(box[x], box[y]) for x, y in (("x1", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y1"))])


def interval_gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Distance between closed intervals; 0 where they touch."""
    return F.greatest(F.lit(0), b1 - a2, a1 - b2)


def contains(box: Column, x: Column, y: Column) -> Column:
    """The point is in the box, sides included."""
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def overlaps(a: Column, b: Column) -> Column:
    """The boxes share area; touching sides don't count."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def intersection_over_union(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = (w * h).cast("double")

    def area(c: Column) -> Column:
        return (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])

    return F.try_divide(both, area(a) + area(b) - both)


def luminance(rgb: Column) -> Column:
    """Relative luminance of a struct (r, g, b) of 0 to 255."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v < 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(rgb["r"]) + 0.7152 * linear(rgb["g"]) + 0.0722 * linear(rgb["b"])


def contrast(a: Column, b: Column) -> Column:
    p, q = luminance(a), luminance(b)
    return (F.greatest(p, q) + 0.05) / (F.least(p, q) + 0.05)


def contrast_filter(df: DataFrame, a: str = "a", b: str = "b", min_contrast: float = 3, alpha_scale: float = 1) -> DataFrame:
    """Pairs of colours (r, g, b, a) whose contrast, times both alphas, is enough.

    Alphas run to 255, so with alpha_scale 1 nearly all pass; 255 weighs by opacity.
    """
    weight = (F.col(a)["a"] / alpha_scale) * (F.col(b)["a"] / alpha_scale)
    return df.filter(weight * contrast(F.col(a), F.col(b)) >= min_contrast)


def filter_detections(df: DataFrame, min_confidence: float = 0) -> DataFrame:
    """Detections with a value and at least the confidence."""
    return df.filter((F.col("value") != "") & (F.col("confidence") >= min_confidence))


def to_page_box(df: DataFrame, box: str = "box") -> DataFrame:
    """df (rx1, ry1, rx2, ry2 relative to the crop box) with page_box, truncated, and the untruncated centre center_x, center_y."""
    c = F.col(box)
    w, h = c["x2"] - c["x1"], c["y2"] - c["y1"]
    x1, x2 = F.col("rx1") * w + c["x1"], F.col("rx2") * w + c["x1"]
    y1, y2 = F.col("ry1") * h + c["y1"], F.col("ry2") * h + c["y1"]
    return df.withColumns({"page_box": make_box(y1, x1, y2, x2), "center_x": (x1 + x2) / 2, "center_y": (y1 + y2) / 2})


def resized_dims(w: Column, h: Column, ratio: Column) -> Column:
    """struct (w, h) after scaling, truncated; a null or zero ratio changes nothing."""
    keep = ratio.isNull() | (ratio == 0)
    return F.struct(F.when(keep, w).otherwise((w * ratio).cast("int")).alias("w"), F.when(keep, h).otherwise((h * ratio).cast("int")).alias("h"))


def span_filter(df: DataFrame, x1: str = "x1", x2: str = "x2", low: str = "low", high: str = "high", min_frac: float = 0.2) -> DataFrame:
    """Spans in rising order that take at least the share of their range; empty ones go."""
    a, b = F.least(x1, x2), F.greatest(x1, x2)
    return df.withColumns({x1: a, x2: b}).filter((F.col(x1) < F.col(x2)) & (F.try_divide(F.col(x2) - F.col(x1), F.col(high) - F.col(low)) >= min_frac))
