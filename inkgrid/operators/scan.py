"""Scans in order within a key (a run, a page), spread over ranges of rows, so that one key may have any share of them.

Rows are dealt out by range of (key, order) and written with their range's number (RANGE).  Window
functions then work on the rows that a key has in one range; what comes in from the ranges before is a
summary of each, put together by an associative step.  At most one key goes over an edge between
two ranges, so at most two summaries for each range are sent to all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.storage import materialise

RANGE = "__range"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df, stored by ranges of keys and order, with the number of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def within(keys: list[str], order: list[str], last: int = 0) -> WindowSpec:
    """The rows of a key in one range, in order: from its first up to the current one, or to the one before (last=-1)."""
    return Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """rows with the last column of carry: what the ranges before know of the row's key; null in a key's only range.

    summary: aggregates of a key's rows in one range.  carry: columns of summaries, each made after those before it
    from a window over the ranges of the key.
    """
    each = rows.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    key = Window.partitionBy(*keys)
    over = each.withColumn("__ranges", F.count("*").over(key)).filter("__ranges > 1")
    for name, make in carry.items():
        over = over.withColumn(name, make(key.orderBy(RANGE)))
    found = over.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(RANGE).alias("__of"), name)
    same = F.col(RANGE) == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(F.broadcast(found), same, "left").drop("__of", *[f"__{k}" for k in keys])


def earlier(aggregate: Callable[[Column | str], Column], column: str) -> Callable[[WindowSpec], Column]:
    """Carries an aggregate of a summary over all ranges before."""
    return lambda w: aggregate(F.col(column)).over(w.rowsBetween(Window.unboundedPreceding, -1))


def numbered(rows: DataFrame, keys: list[str], order: list[str], output: str = "place") -> DataFrame:
    """Ranged rows with their place within their key, from 0."""
    out = carried(rows, keys, {"__n": F.count("*")}, {"__before": earlier(F.sum, "__n")})
    return out.withColumn(output, F.row_number().over(Window.partitionBy(RANGE, *keys).orderBy(*order)) - 1 + F.coalesce("__before", F.lit(0))).drop("__before")


def with_halo(rows: DataFrame, place: str, halo: int, size: int) -> DataFrame:
    """rows (with places from 0 within a key) in blocks of size places; the last `halo` rows of a block are in the next one, too.

    Adds __block and __copy (true for those rows); size is at least halo.
    """
    own = F.floor(F.col(place) / size)
    both = F.when(F.col(place) % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("__block", F.explode(both)).withColumn("__copy", F.col("__block") > own)
