"""Connected components of a link table, by alternating large-star and small-star steps, and the first independent set of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise


def _star(links: DataFrame) -> DataFrame:
    """links (u, v) with each u's neighbours v joined to the least of them and u itself: (v, least)."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the least id that is reachable.

    Links may repeat, run both ways or join an id to itself.  An empty table gives no rows.
    Each round halves the longest chain, roughly; hubs are aggregated before they are joined.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    was = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        grown = _star(large)
        small = grown.select(F.col("v").alias("u"), F.col("m").alias("v")).union(grown.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == was or now[0] == 0:
            break
        was = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # In the end every edge leads to a root, and roots are on the right only.
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def not_independent(links: DataFrame) -> DataFrame:
    """id and round of what is not in the first independent set: taken in order, what no link joins to something taken before.

    links (a, b): a comes before b in the order.  A round takes all that have no link from before, and what they link to
    goes; the number of rounds is about the logarithm of the links if the order is random, and the longest chain at most.
    """
    left = materialise(links.distinct())
    out, number = left.select(F.col("b").alias("id"), F.lit(0).alias("round")).limit(0), 0
    while not left.isEmpty():
        number += 1
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        gone = materialise(left.join(first, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        out = out.union(gone.withColumn("round", F.lit(number)))
        left = materialise(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    return out
