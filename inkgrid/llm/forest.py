"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every tree gives a vector a long bit string (signs of random projections) and is a
sorted array of these strings.  A query descends in all trees to the longest prefix it
shares, then ascends in all of them at once, one bit at a time, until the vectors below
its prefixes are `candidates` in all; these are scored.  Vectors are lengthened by one
component so that all have one norm, which turns the largest inner product into the
smallest angle.

The forest is split by vectors: a shard holds the trees of some thousand vectors, and
the queries visit all shards in blocks; queries that share a prefix are scored together
as one product of matrices.  Each shard gives its best for each query, so what is
merged is k rows for each query and shard.  The index takes in every vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors meet only those with as many components; equal vectors are indexed once
and answer with their smallest ids; equal scores go by the smaller id; rows with the
query's own id aren't its neighbours; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREES = 96
DEPTH = 24  # bits
SHARD = 8192  # vectors
QUERIES = 2048  # in a block
CANDIDATES = 4096  # in a shard, over all trees


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit strings by tree, as numbers: trees x vectors."""
    depth = planes.shape[1] // TREES
    signs = (vectors @ planes > 0).reshape(len(vectors), TREES, depth)
    return (signs @ (1 << np.arange(depth - 1, -1, -1))).T.astype(np.int64)


def _merge(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> None:
    """Put candidates (one line for each of rows) into best, each vector once."""
    s = np.concatenate((best[0][rows], score), axis=1)
    v = np.concatenate((best[1][rows], at), axis=1)
    order = np.argsort(v, axis=1, kind="stable")
    s, v = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
    s[:, 1:][(v[:, 1:] == v[:, :-1])] = -np.inf
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    best[0][rows], best[1][rows] = np.take_along_axis(s, top, 1), np.take_along_axis(v, top, 1)


def search(data: np.ndarray, queries: np.ndarray, k: int, longest: float, candidates: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k best vectors found: scores and places in data (place -1, score -inf: none)."""
    n, dim = data.shape
    planes = np.random.default_rng(dim).standard_normal((dim + 1, TREES * DEPTH)).astype(np.float32)
    scaled = data / longest
    tall = np.concatenate((scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))[:, None]), axis=1).astype(np.float32)
    flat = np.concatenate((queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))), axis=1).astype(np.float32)
    mine, asked = strings(tall, planes), strings(flat, planes)
    order = np.argsort(mine, axis=1, kind="stable")
    arrays = np.take_along_axis(mine, order, 1)

    # Ascend in all trees at once: the deepest level with enough vectors below.
    level = np.zeros(len(queries), np.int64)
    waiting = np.arange(len(queries))
    for depth in range(min(DEPTH, int(np.ceil(np.log2(n + 1))) + 2), 0, -1):
        shift = DEPTH - depth
        total = np.zeros(len(waiting), np.int64)
        for a, q in zip(arrays, asked):
            low = q[waiting] >> shift << shift
            total += np.searchsorted(a, low + (1 << shift)) - np.searchsorted(a, low)
        enough = total >= candidates
        level[waiting[enough]] = depth
        waiting = waiting[~enough]
        if not len(waiting):
            break

    best = (np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1))
    for tree, (a, q) in enumerate(zip(arrays, asked)):
        shift = DEPTH - level
        low = q >> shift << shift
        first, last = np.searchsorted(a, low), np.searchsorted(a, low + (1 << shift))
        group = np.lexsort((last, first))
        new = np.flatnonzero(np.concatenate(([True], (first[group][1:] != first[group][:-1]) | (last[group][1:] != last[group][:-1]))))
        rows_, score_, at_ = [], [], []
        for i, j in zip(new, np.append(new[1:], len(group))):
            rows = group[i:j]
            if level[rows[0]] == 0 and tree:
                continue  # at the roots every tree has all vectors
            places = order[tree, first[rows[0]] : last[rows[0]]]
            if not len(places):
                continue
            score = queries[rows] @ data[places].T
            m = min(k, len(places))
            top = np.argpartition(-score, m - 1, axis=1)[:, :m]
            s = np.full((len(rows), k), -np.inf)
            p = np.full((len(rows), k), -1)
            s[:, :m], p[:, :m] = np.take_along_axis(score, top, 1), places[top]
            rows_.append(rows), score_.append(s), at_.append(p)
        if rows_:
            _merge(best, np.concatenate(rows_), np.concatenate(score_), np.concatenate(at_), k)
    best[1][np.isneginf(best[0])] = -1
    return best


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the forest finds for every row where queries is true."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, asks, longest = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")), F.max(norm)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-(asks or 0) // QUERIES))
    data = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = rows.filter("asks").select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    cell = ["dim", "shard", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            left, right = left.sort_by("id").combine_chunks(), right.combine_chunks()
            x, q = (np.array(t["v"].combine_chunks().flatten()).reshape(-1, dim) for t in (left, right))
            ids, asking = left["id"].to_numpy(), right["id"].to_numpy()
            x = x + 0.0  # no negative zeros
            _, first, of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True)
            members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
            _, places = search(x[first], q, min(k + 1, max(1, len(first))), longest, candidates)
            for i, found in enumerate(places):
                rows = np.concatenate([members[p][: k + 1] for p in found if p >= 0]) if (found >= 0).any() else np.zeros(0, np.int64)
                rows = rows[ids[rows] != asking[i]]
                score = (x[rows] * q[i]).sum(axis=1)
                top = np.lexsort((ids[rows], -score))[:k]
                out["query_id"].append(np.full(len(top), asking[i]))
                out["vec_id"].append(ids[rows[top]])
                out["score"].append(score[top])
        empty = np.zeros(0)
        cols = {c: np.concatenate([*v, empty]) if c == "score" else np.concatenate([*v, empty.astype(np.int64)]) for c, v in out.items()}
        return pa.table(cols)

    found = data.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


def op3(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, F.col("vec_id") % 20 == 0)
