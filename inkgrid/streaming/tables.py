"""Structured Streaming forms of the vocabulary and of label intake."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import LATIN, hangul_syllables, in_alphabet, strip_punctuation, words
from ..operators.labels import dedupe_labels
from ..sources.storage import materialise


def stream_vocab(stream: DataFrame, text: str = "text", alphabet: str | None = None, mode: str = "run") -> DataFrame:
    """id and count over all that has arrived; write it in complete mode.  The state is the distinct words."""
    alphabet = hangul_syllables() + LATIN if alphabet is None else alphabet
    found = stream.select(F.explode(words(F.col(text))).alias("w")).select(strip_punctuation(F.col("w"), mode).alias("id"))
    return found.filter(in_alphabet(F.col("id"), alphabet)).groupBy("id").count()


def write_stream_vocab(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table at path (id, count) at all that has arrived, whatever is replayed."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Buckets of a label table, and bits of a bucket's filter: under 1 % of new ids pass it by chance up to a hundred thousand ids.
BUCKETS, BITS, HASHES = 64, 1 << 20, 7


def _there(session: SparkSession, path: str) -> bool:
    p = session._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _positions(hashes: np.ndarray) -> np.ndarray:
    """Places of bits for each hash, one row each."""
    h = hashes.astype(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64)


def _bits(table: pa.Table) -> np.ndarray:
    body = table["bits"][0].as_buffer() if table.num_rows else bytes(BITS // 8)
    return np.frombuffer(body, np.uint8).copy()


def _maybe_known(left: pa.Table, right: pa.Table) -> pa.Table:
    """Ids of a bucket that its filter doesn't rule out; without a filter, all of them."""
    if right.num_rows and left.num_rows:
        at = _positions(left["hash"].to_numpy())
        hit = (_bits(right)[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
        left = left.filter(pa.array(hit))
    return left.select(["bucket", "id"])


def _with_new(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's filter with its new ids."""
    bits, at = _bits(right), _positions(left["hash"].to_numpy()).ravel()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    bucket = (left if left.num_rows else right)["bucket"][:1]
    return pa.table({"bucket": bucket, "bits": pa.array([bits.tobytes()], pa.binary())})


def possible_buckets(new: DataFrame, path: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """For new rows (id, hash, bucket) and the table at path: ids that may be in it, the filters, and the buckets to be read."""
    session = new.sparkSession
    filters, schema = f"{path}__filters", "bits binary, bucket int"
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    there = _there(session, filters) and _there(session, path)
    kept = session.read.schema(schema).parquet(filters) if there else session.createDataFrame([], schema)
    kept = materialise(kept.filter(F.col("bucket").isin(touched)).select("bucket", "bits"))
    by = lambda df: df.groupBy("bucket")
    maybe = by(new.select("bucket", "id", "hash")).cogroup(by(kept)).applyInArrow(_maybe_known, "bucket int, id string") if there else new.select("bucket", "id").limit(0)
    maybe = materialise(maybe)
    return maybe, kept, sorted(r[0] for r in maybe.select("bucket").distinct().collect())


def stream_labels(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends labels (id, data) to the table at path, each id once; null ids or data are dropped.  A replayed batch adds nothing.

    The table is dealt in BUCKETS by a hash of the id.  Beside it, each bucket has a Bloom filter of its ids, of fixed
    size; a batch reads the filters of its buckets, and of the table only the ids of buckets with an id that the filter
    lets through.  Filters are written before the labels, so a batch that fails in between is only
    read for more than it needs; a bucket whose filter is missing is read.
    """

    def put(batch: DataFrame, number: int) -> None:
        new = dedupe_labels(batch.filter("id is not null and data is not null").select("id", "data"), ["data"])
        new = materialise(new.withColumn("hash", F.xxhash64("id")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int")))
        session = batch.sparkSession
        maybe, filters, hits = possible_buckets(new, path)
        if hits:
            known = session.read.schema("id string, data string, bucket int").parquet(path).filter(F.col("bucket").isin(hits)).select("id")
            new = materialise(new.join(known.join(maybe.select("id"), "id", "left_semi"), "id", "left_anti"))
        if new.isEmpty():
            return
        by = lambda df: df.groupBy("bucket")
        grown = materialise(by(new.select("bucket", "hash")).cogroup(by(filters)).applyInArrow(_with_new, "bucket int, bits binary"))
        grown.select("bits", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}__filters")
        new.select("id", "data", "bucket").write.mode("append").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
