"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again before the next.  All but the last return the columns of documents.

Defined cases, for every stage: documents with a null id are judged by the rules, are never near-duplicates or
sources of passages, get surrogates and are packed; a null or empty text fails the quality rules; long texts are worked on
whole; repeated rows are near-duplicates of each other unless their id is null or one, as texts under one id are one
document; an empty table gives an empty one; columns beside those of documents, whatever their names, are handed on by
all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkgrid.llm import minhash, packing, privacy, quality, substrings
from inkgrid.llm.tables import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, quality.references(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out."""
    return substrings.without_repeats(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; the setting inkgrid.surrogates.key holds the key (unset: a published one, so that the pipeline runs as it is; set your own)."""
    key = spark.conf.get("inkgrid.surrogates.key", None)
    return privacy.without_private(docs, key.encode() if key else privacy.TEST_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.tokenise_and_pack(docs, packing.model_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated spans", repeated_spans),
    ("private data", private_data),
    ("packing", packed),
]

#: Similarity links, surrogates and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
