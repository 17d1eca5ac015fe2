"""Small helpers that the operators share: shared storage, Arrow columns, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

#: Bytes of text that are hashed at once inside a task (one document at least).
CHUNK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, written to the shared folder (a folder for each value of `by`) and read back: it is computed once, and lost executors cost no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*[by] if by else []).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(df: DataFrame, by: str | None = None) -> DataFrame:
    """stored, and what was shuffled for it is removed from the executors' disks as soon as it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(df, by)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def bucketed(df: DataFrame, by: str, n: int) -> tuple[DataFrame, str]:
    """df, written to the shared folder in n buckets by a column, so that groups and joins by it move none of its rows, and the table's name."""
    spark, name = df.sparkSession, f"t{uuid.uuid4().hex}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def forget(df: DataFrame, but: str | None = None) -> None:
    """Removes what `stored` wrote for df, but for folders of that name."""
    folders = {x.rsplit("/", 1)[0] for x in df.inputFiles()}
    for folder in {x for x in folders if x.rsplit("/", 1)[1] != but}:
        session = df.sparkSession
        p = session._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unused(name: str, columns: list[str]) -> str:
    """name, made longer until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def aliased(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named in0, in1, ... so that an operator's own names can't be among them, and the new name of each."""
    names = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names


#: A value is a hub if more than one in so many rows have it; a hub's rows go to so many tasks.
HUBS, PARTS = 256, 32


def hub_join(left: DataFrame, right: DataFrame, on: str, counted: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """left joined to right on `on` and also; right has one row for each value of these, few values of `on` may have most of left's rows.

    counted is a stored table with left's values of `on`, or more.  A hub's rows (HUBS values at
    most are hubs) are dealt to PARTS tasks, to each of which the hub's rows of right go.
    """
    n = counted.count()
    hubs = [r[0] for r in counted.groupBy(on).count().filter(F.col("count") * HUBS > max(n, 100 * HUBS)).collect()]
    if not hubs:
        return left.join(right, [on, *also])
    is_hub, all_parts = F.col(on).isin(hubs), F.sequence(F.lit(0), F.lit(PARTS - 1))
    left = left.withColumn("__part", F.when(is_hub, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).otherwise(0))
    right = right.withColumn("__part", F.explode(F.when(is_hub, all_parts).otherwise(F.array(F.lit(0)))))
    return left.join(right, [on, *also, "__part"]).drop("__part")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts and ends in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that aren't ASCII white space) of consecutive rows.

    Returns their 64-bit hashes, their starts and ends in data[offsets[0]:offsets[-1]], and
    the number of words before each row (one more entry than rows).
    """
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    if lower:
        b = _LOWER[b]
    n = len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[b]
    edge = np.zeros(n + 1, bool)  # a row's first byte never goes on with the row before
    edge[offsets - base] = True
    starts = np.flatnonzero(inside & (edge[:n] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    before = np.searchsorted(starts, offsets - base)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, before
    at = np.arange(n, dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    at[: starts[0]] = 0
    longest = int(np.max(np.diff(np.append(starts, n))))
    value = (b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, longest + 1)[at]
    value[~inside] = 0
    sums = np.add.reduceat(value, starts)
    return mixed(sums + (ends - starts).astype(np.uint64)), starts, ends, before


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if size <= 8:
        for k in range(size):
            out = (out + values[k : k + n]) * _BASE
        return mixed(out)
    # Doubling: hashes of runs of 1, 2, 4, ... values, put together as the bits of size ask.
    part, length, done = values, 1, 0
    while True:
        if size & length:
            out = out * _BASE + part[done : done + n]
            done += length
        if 2 * length > size:
            return mixed(out)
        part = mixed(part[:-length] * np.uint64(0xD6E8FEB86659FD93) + part[length:])
        length *= 2
