"""Weighted vocabularies from corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LATIN, hangul_syllables, in_alphabet, strip_punctuation, words


def count_words(df: DataFrame, text: str = "text", alphabet: str | None = None, mode: str = "run") -> DataFrame:
    """id and count of the words of a column that are made of the alphabet (default: Hangul, digits and Latin).

    Words are counted before they are tested, so each distinct word is tested once; partial
    aggregation takes care of frequent words.
    """
    alphabet = hangul_syllables() + LATIN if alphabet is None else alphabet
    counted = df.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    cleaned = counted.select(strip_punctuation(F.col("w"), mode).alias("id"), "n").filter(in_alphabet(F.col("id"), alphabet))
    return cleaned.groupBy("id").agg(F.sum("n").alias("count"))


def apply_floor(vocab: DataFrame, latin: int = 1000, hangul: int = 10, hangul_alphabet: str | None = None) -> DataFrame:
    """The vocabulary in which each single character has at least its floor; a floor of 0 is no floor."""
    spark = vocab.sparkSession
    floors = [(c, n) for chars, n in ((LATIN, latin), (hangul_syllables() if hangul_alphabet is None else hangul_alphabet, hangul)) if n for c in chars]
    if not floors:
        return vocab.groupBy("id").agg(F.max("count").alias("count"))
    table = spark.createDataFrame(floors, "id string, count long")
    return vocab.select("id", F.col("count").cast("long")).unionByName(table).groupBy("id").agg(F.max("count").alias("count"))


def vocab_summary(vocab: DataFrame) -> DataFrame:
    """n_words and total."""
    return vocab.agg(F.count("*").alias("n_words"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def cap_frequency(vocab: DataFrame, fraction: float = 0.0003) -> DataFrame:
    """id, count and weight: count, at most int(words * fraction), which is 0 for small vocabularies."""
    cap = vocab.agg((F.count("*") * F.lit(fraction)).cast("long").alias("cap"))
    return vocab.crossJoin(F.broadcast(cap)).select("id", "count", F.least("count", "cap").alias("weight"))  # one row is broadcast


def cap_report(capped: DataFrame, fraction: float = 0.0003) -> DataFrame:
    """cap, total weight, and cap as a share of the total (null where the total is 0)."""
    out = capped.agg((F.count("*") * F.lit(fraction)).cast("long").alias("cap"), F.sum("weight").alias("total"))
    return out.withColumn("share", F.try_divide(F.col("cap").cast("double"), F.col("total").cast("double")))


def read_corpora(sources: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """source and text of all sources, duplicates kept; each source comes with the column that picks its text."""
    out = None
    for name, df, getter in sources:
        one = df.select(F.lit(name).alias("source"), getter.cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
