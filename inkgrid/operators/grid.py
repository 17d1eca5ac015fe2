"""Boxes that overlap, by an equi-join on cells of a grid.

A cell is as high and wide as the boxes of its key are in the root of the mean square.  So, by the inequality of
Cauchy and Schwarz, boxes reach four cells each on the average at most, however sizes are mixed.  A pair
is met once, in the cell that holds the corner where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import overlaps


def box_of(alias: str) -> Column:
    return F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in ("y1", "x1", "y2", "x2")])


def _sizes(boxes: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys and the size of their cells."""
    side = lambda a, b: (F.col(b) - F.col(a)).cast("double")
    each = [b.select(*keys, side("y1", "y2").alias("h"), side("x1", "x2").alias("w")) for b in boxes]
    rows = each[0] if len(each) == 1 else each[0].unionByName(each[1])
    root = lambda c: F.greatest(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(1e-6))
    return rows.groupBy(*keys).agg(root("h").alias("__h"), root("w").alias("__w"))


def celled(boxes: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each cell (__cy, __cx) that a box reaches."""
    cells = lambda a, b, size: F.sequence(F.floor(F.col(a) / F.col(size)), F.floor(F.greatest(F.col(a), F.col(b)) / F.col(size)))
    rows = boxes.join(sizes, keys).withColumn("__cy", F.explode(cells("y1", "y2", "__h")))
    return rows.withColumn("__cx", F.explode(cells("x1", "x2", "__w")))


def meetings(left: DataFrame, right: DataFrame | None, keys: list[str]) -> DataFrame:
    """Pairs of rows of equal keys, as l and r, whose boxes (y1, x1, y2, x2) share area; right None: of left with itself, each pair both ways."""
    sizes = _sizes([left] if right is None else [left, right], keys)
    l = celled(left, sizes, keys).alias("l")
    r = celled(left if right is None else right, sizes, keys).alias("r")
    at = lambda first, size: F.floor(F.greatest(F.col(f"l.{first}"), F.col(f"r.{first}")) / F.col(f"l.{size}"))
    on = (F.col("l.__cy") == F.col("r.__cy")) & (F.col("l.__cx") == F.col("r.__cx"))
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    begins = (F.col("l.__cy") == at("y1", "__h")) & (F.col("l.__cx") == at("x1", "__w"))
    return l.join(r, on & begins & overlaps(box_of("l"), box_of("r")))
