"""Whitening of embeddings by an incremental eigendecomposition.

The covariance is that of the distinct vectors, as whole numbers: floor(64 c) + 1000000.

1. Each partition keeps mean, scatter's eigenvalues and eigenvectors of the vectors it has seen.  A
   new vector is a rank-one update of the scatter, centred at the running mean: its secular equation
   is solved for all eigenvalues at once, after deflation of directions it doesn't touch and of
   equal eigenvalues, and the eigenvectors are turned by what follows.
2. Spectra of partitions are combined in a tree of groups of WIDTH: the scatter of one is added
   to the other as rank-one updates, an eigenvector at a time, and one more for the distance of
   the means.
3. Rayleigh-Ritz: all vectors are projected on the combined basis, their scatter there, a small
   nearly diagonal matrix, is added up over partitions in the same tree, and its eigenvectors turn the
   basis.  This is done again until what is off the diagonal is rounding.

What leaves a task is a row of dim * dim numbers; the driver sees one such row, whatever the number of
rows or partitions.  Distinct vectors are found by a shuffle that combines copies first, so many copies
of one vector cost nothing.  Dimensions of some thousands are meant; a basis is sent with the tasks.

Defined cases: vectors that are null or hold entries that are null, NaN or infinite are dropped, and so are those
whose length isn't the commonest (of equally common ones the largest); entries are held within 2^52 after
scaling; null ids and repeated rows are rows like others; components without variance (below 1e-12 of
the total) don't exist, so a table with one distinct vector, or none, gives no rows; deviation is null
where it is beyond a long; other columns, whatever their names, don't matter and aren't handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**52
#: Rows of partial results that one task adds up.
WIDTH = 16
#: Steps in the secular equation, at most; half a dozen do, as a rule, and each that fails halves a bracket.
STEPS = 60
SUMS = "part long, n long, mean array<double>, values array<double>, basis array<double>"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long") + SHIFT))


def updated(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of basis * diag(values) * basis' + weight * vector * vector'."""
    z = basis.T @ vector
    size = weight * float(z @ z)
    if size <= 0.0:
        return values, basis
    tiny = 8 * np.finfo(float).eps * max(float(values[-1]), size)
    # Deflation: directions the vector doesn't touch stay; of equal eigenvalues one direction takes all of it.
    free = weight * np.abs(z) * np.sqrt(float(z @ z)) > tiny
    close = np.flatnonzero(free)
    for i, j in zip(close[:-1], close[1:]):
        if values[j] - values[i] <= tiny:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            basis[:, i], basis[:, j] = c * basis[:, i] - s * basis[:, j], s * basis[:, i] + c * basis[:, j]
            z[i], z[j], free[i] = 0.0, r, False
    at = np.flatnonzero(free)
    if not len(at):
        return values, basis
    d, y = values[at], z[at] * np.sqrt(weight)
    k = len(at)
    gap = np.append(np.diff(d), float(y @ y))
    # Each root is kept as a distance from the nearer pole, so that differences don't cancel.
    y2 = y * y
    half = d + gap / 2
    upper = 1.0 + (y2 / (d[None, :] - half[:, None])).sum(axis=1) < 0  # the root is in the right half
    upper[-1] = False
    pole = np.where(upper, np.arange(k) + 1, np.arange(k)).clip(max=k - 1)
    to_pole = d[None, :] - d[pole][:, None]
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
    high[-1] = gap[-1]
    root = (low + high) / 2
    left, right = np.append(d, 0.0)[:k] - d[pole], np.append(d[1:], d[-1] + gap[-1]) - d[pole]  # the two poles around each root
    before = np.tri(k)  # the poles left of each root, whose parts are below 0
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            away = to_pole - root[:, None]
            part = y2 / away
            f = 1.0 + part.sum(axis=1)
            below = f < 0
            low, high = np.where(below, root, low), np.where(below, high, root)
            done = np.abs(f) <= 4 * np.finfo(float).eps * (f - 2 * np.einsum("ij,ij->i", part, before))
            if done.all():
                break
            # A root of c + a / (left - x) + b / (right - x), which agrees with f and its slopes from either side.
            slopes = part / away
            rise, all_rise = np.einsum("ij,ij->i", slopes, before), slopes.sum(axis=1)
            wl, wr = left - root, right - root
            c = f - rise * wl - (all_rise - rise) * wr
            b = (wl + wr) * f - wl * wr * all_rise
            r = np.sqrt(np.maximum(b * b - 4 * c * wl * wr * f, 0.0))
            step = np.where(b > 0, 2 * wl * wr * f / (b + r), (b - r) / (2 * c))
            step[-1] = wl[-1] + rise[-1] * wl[-1] ** 2 / (f[-1] - rise[-1] * wl[-1])
            new = root + step
            root = np.where(done, root, np.where((new > low) & (new < high), new, (low + high) / 2))
    apart = to_pole - root[:, None]  # pole minus root; row: root
    # The vector for which these roots are exact (Gu and Eisenstat): its eigenvectors are orthogonal.
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = -apart / np.where(between == 0, 1.0, -between)
    ratio[np.arange(k), np.arange(k)] = -apart[np.arange(k), np.arange(k)]
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0)))
    turn = (np.where(y < 0, -exact, exact)[None, :] / np.where(apart == 0, np.finfo(float).tiny, apart)).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, basis = values.copy(), basis.copy()
    values[at] = d[pole] + root
    basis[:, at] = basis[:, at] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number, mean and scatter (by eigenvalues and eigenvectors) of the vectors seen."""

    def __init__(self, dim: int, n: int = 0, mean: np.ndarray | None = None, values: np.ndarray | None = None, basis: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(dim) if mean is None else mean
        self.values = np.zeros(dim) if values is None else values
        self.basis = np.eye(dim) if basis is None else basis

    def add(self, vector: np.ndarray) -> None:
        away = vector - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self.values, self.basis = updated(self.values, self.basis, away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = updated(self.values, self.basis, vector, float(value))
        self.values, self.basis = updated(self.values, self.basis, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def row(self, part: int) -> pa.RecordBatch:
        lists = [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (self.mean, self.values, self.basis)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), *lists], names=["part", "n", "mean", "values", "basis"])


def spectra(table: pa.Table) -> Iterator[Spectrum]:
    for r in table.sort_by("part").to_pylist():
        dim = len(r["mean"])
        yield Spectrum(dim, r["n"], np.array(r["mean"]), np.array(r["values"]), np.array(r["basis"]).reshape(dim, dim))


def matrix(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, dim)


def _partials(vectors: DataFrame, make: Callable[[Iterator[np.ndarray]], pa.RecordBatch | None], dim: int, schema: str) -> DataFrame:
    """A row for each partition of vectors (x) that has any; part is its number."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(matrix(b, 0, dim) for b in batches if b.num_rows)
        if out is not None:
            yield out.set_column(0, "part", pa.array([TaskContext.get().partitionId()], pa.int64()))

    return stored(vectors.mapInArrow(run, schema))


def _tree(rows: DataFrame, join: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """rows (part, ...) joined by groups of WIDTH until one is left."""
    n = rows.agg(F.max("part")).first()[0]
    while n:
        n //= WIDTH
        rows = stored(rows.withColumn("part", F.floor(F.col("part") / WIDTH)).groupBy("part").applyInArrow(join, schema))
    return rows


def _added(table: pa.Table) -> pa.Table:
    """Rows (part, n, sums) of one part, summed."""
    sums = np.asarray(table["sums"].combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"part": table["part"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sums": pa.array([sums.tolist()], table["sums"].type)})


def column_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and, for each dimension, the sum of vectors (x), in whole numbers."""

    def make(found: Iterator[np.ndarray]) -> pa.RecordBatch | None:
        n, total = 0, [0] * dim
        for x in found:
            n += len(x)
            total = [t + int(v) for t, v in zip(total, x.astype(object).sum(axis=0) if abs(x).max() > 2**40 else x.sum(axis=0))]
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(t) for t in total]])], names=["part", "n", "sums"]) if n else None

    def join(table: pa.Table) -> pa.Table:
        sums = [str(sum(map(int, v))) for v in zip(*table["sums"].to_pylist())]
        return pa.table({"part": table["part"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sums": pa.array([sums])})

    schema = "part long, n long, sums array<string>"
    r = _tree(_partials(vectors, make, dim, schema), join, schema).first()
    return r["n"], [int(t) for t in r["sums"]]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n * x - sums where exact in doubles, x - sums / n, and n times a whole number near the mean, taken out of both first."""
    near = [s // n for s in sums]
    rest = np.array([s - n * m for s, m in zip(sums, near)], np.float64)
    y = x - np.array(near, np.int64)
    return y, rest, y - rest / n


def first_spectrum(vectors: DataFrame, n: int, sums: list[int]) -> Spectrum:
    """By rank-one updates in the partitions of vectors (x), combined in a tree."""
    dim = len(sums)

    def make(found: Iterator[np.ndarray]) -> pa.RecordBatch | None:
        seen = Spectrum(dim)
        for x in found:
            for v in centred(x, n, sums)[2]:
                seen.add(v)
        return seen.row(0) if seen.n else None

    def join(table: pa.Table) -> pa.Table:
        all_of = spectra(table)
        seen = next(all_of)
        for other in all_of:
            seen.merge(other)
        return pa.Table.from_batches([seen.row(table["part"][0].as_py())])

    one = _tree(_partials(vectors, make, dim, SUMS), join, SUMS).first()
    return Spectrum(dim, one["n"], np.array(one["mean"]), np.array(one["values"]), np.array(one["basis"]).reshape(dim, dim))


def covariance(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Of vectors (x) projected on the columns of basis: means taken out before multiplying, divisor n."""
    dim, wide = len(sums), basis.shape[1]

    def make(found: Iterator[np.ndarray]) -> pa.RecordBatch | None:
        count, total = 0, np.zeros((wide, wide))
        for x in found:
            p = centred(x, n, sums)[2] @ basis
            count, total = count + len(x), total + p.T @ p
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([count], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "n", "sums"]) if count else None

    schema = "part long, n long, sums array<double>"
    return np.array(_tree(_partials(vectors, make, dim, schema), _added, schema).first()["sums"]).reshape(wide, wide) / n


def eigenbasis(vectors: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors (columns) and trace of the covariance of distinct vectors (x)."""
    basis = np.linalg.qr(first_spectrum(vectors, n, sums).basis[:, ::-1])[0]
    for _ in range(4):  # two rounds, as a rule
        small = covariance(vectors, n, sums, basis)
        values = np.diag(small)
        off = np.abs(small - np.diag(values)).max()
        if off <= 1e-14 * np.trace(small) and (np.diff(values) <= 0).all():
            break
        turned = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        basis = np.linalg.qr(basis @ turned)[0]
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order], float(np.trace(small))


def _deviation(y: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """sum of (n * y - rest)^2 in whole numbers; null beyond a long."""
    rough = ((n * y.astype(np.float64) - rest) ** 2).sum(axis=1)
    if not len(rough) or rough.max() < 2.0**62:
        return pa.array(((n * y - rest.astype(np.int64)) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, rest.astype(np.int64).tolist())) if size < 2.0**63.5 else None for r, size in zip(y.tolist(), rough.tolist())]
    return pa.array([d if d is not None and d < 2**63 else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error for every usable row and component."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = F.col(vector)
    rows = stored(vectors.filter(usable(v)).select(F.col(key).alias("key"), whole(v).alias("x")))
    lengths = rows.groupBy(F.size("x").alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    if not dim:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rows = rows.filter(F.size("x") == dim)
    distinct = stored(rows.select("x").distinct())
    n, sums = column_sums(distinct, dim)
    values, basis, trace = eigenbasis(distinct, n, sums)
    wide = min(components, int((values > 1e-12 * trace).sum()) if trace > 0 else 0)
    values, basis = values[:wide], basis[:, :wide] / np.sqrt(values[:wide])
    error = float(np.abs(covariance(distinct, n, sums, basis) - np.eye(wide)).max()) if wide else 0.0
    explained = values / trace if wide else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, rest, away = centred(matrix(batch, 1, dim), n, sums)
            m = batch.num_rows
            each = np.repeat(np.arange(m), wide)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, wide + 1), m), pa.int32()),
                    pa.array(np.full(m * wide, n), pa.int64()),
                    _deviation(y, rest, n).take(pa.array(each)),
                    pa.array((away @ basis).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * wide, error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
