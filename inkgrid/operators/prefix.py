"""Running sums, global row numbers, splits and batches without a single-task window.

Rows are dealt out by range and written with their partition's number; the sums of the
partitions (one row for each) give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialise


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each output: column of sums, the sum of the column up to and with each row.

    order must tell all rows apart; null counts as 0.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    value = {o: F.coalesce(F.col(c), F.lit(0)) for o, c in sums.items()}
    ends = ranged.groupBy("__part").agg(*[F.sum(v).alias(f"__sum_{o}") for o, v in value.items()])  # one row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("__part", *[F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__offset_{o}") for o in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__part")
    return out.withColumns({o: F.sum(v).over(within) + F.col(f"__offset_{o}") for o, v in value.items()}).drop("__part", *[f"__offset_{o}" for o in sums])


def running_sum(df: DataFrame, order: list[str], column: str, output: str = "running") -> DataFrame:
    """df with the sum of column up to and with each row.  order must tell all rows apart; null counts as 0."""
    return running_sums(df, order, {output: column})


def row_numbers(df: DataFrame, order: list[str], output: str = "rn") -> DataFrame:
    """df with its global row number, from 1."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", output).drop("__one")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with its row number (rn) in an order that depends on seed and key alone."""
    mixed = df.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return row_numbers(mixed, ["__order", key]).drop("__order")


def split_labels(df: DataFrame, split: float = 0.1, seed: str = "0", key: str = "id") -> DataFrame:
    """df with split: exactly int((1 - split) * n) rows are "train", the others "val"."""
    numbered = shuffled(df, key, seed)
    total = df.agg((F.count("*") * F.lit(1 - split)).cast("long").alias("__train"))
    out = numbered.crossJoin(F.broadcast(total))  # one row is broadcast
    return out.withColumn("split", F.when(F.col("rn") <= F.col("__train"), "train").otherwise("val")).drop("rn", "__train")


def assign_batches(df: DataFrame, size: int, shuffle: bool = False, drop_last: bool = False, seed: str = "0", key: str = "id") -> DataFrame:
    """df with batch numbers from 0; a short last batch may be dropped."""
    numbered = shuffled(df, key, seed) if shuffle else row_numbers(df, [key])
    out = numbered.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))
    if drop_last:
        whole = df.agg(F.floor(F.count("*") / size).cast("long").alias("__whole"))
        out = out.crossJoin(F.broadcast(whole)).filter("batch < __whole").drop("__whole")
    return out.drop("rn")


def sticky_split(labels: DataFrame, old: DataFrame, split: float = 0.1, seed: str = "0", key: str = "id") -> DataFrame:
    """labels with split, in which keys of old (key, split) keep their side, or both sides, and new keys are split anew."""
    kept = labels.join(old.select(key, "split").distinct(), key)
    new = labels.join(old.select(key).distinct(), key, "left_anti")
    return kept.unionByName(split_labels(new, split, seed, key))


def take_samples(df: DataFrame, n: int, key: str = "id", result: str = "result") -> DataFrame:
    """The first n rows, by key, that have a result."""
    return df.filter(F.col(result).isNotNull()).orderBy(key).limit(n)


def limit_items(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)


