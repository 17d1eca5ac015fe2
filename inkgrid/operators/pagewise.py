"""Work on whole pages: rows of a page that are read one after the other go to their page's task as one packed body.

A row for each word is mostly repeated keys and numbers that follow from its neighbours.  Packed by columns, in planes
of bytes, and compressed, a page takes about what its text does, and it is moved once.  A page may come in any number
of bodies, so where its rows lie decides nothing.  Pages of more than MOST rows are left to a way that spreads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialise

#: Rows of a page from which on it is spread, and rows that a task takes at once, about.
MOST = 1 << 16
_WIDE = {T.ByteType: "i1", T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8"}

#: Makes rows of result from the keys of some pages, the rows that each table has of them (by page, in no order within one), and where each page begins and ends there.
Work = Callable[[pa.Array, list[pa.Table], list[np.ndarray]], pa.Table]


def edges_of(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    codes = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    codes = codes.dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)])) if len(codes) else np.zeros(1, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = MOST) -> Iterator[pa.Table]:
    """Batches put together to so many rows or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Columns:
    """Bodies of the rows of a schema, but for the key: numbers, strings and their nulls."""

    def __init__(self, fields: list[T.StructField]):
        self.fields = [(f.name, _WIDE.get(type(f.dataType))) for f in fields]

    @staticmethod
    def fit(fields: list[T.StructField]) -> bool:
        return all(type(f.dataType) in _WIDE or f.dataType == T.StringType() for f in fields)

    def bodies(self, rows: pa.Table, edges: np.ndarray) -> list[bytes]:
        squeeze = zstandard.ZstdCompressor(level=3)
        made: list[list] = [[] for _ in edges[1:]]
        ends = edges.tolist()
        for name, wide in self.fields:
            c = rows.column(name).combine_chunks() if rows.num_rows else pa.array([])
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            null = c.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) if c.null_count else None
            if wide:
                v = (c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False).astype(wide, copy=False)
                planes = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize)
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    made[k].append(planes[a:b].T.tobytes())
            else:
                c = c.fill_null("") if c.null_count else c
                at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
                data = memoryview(c.buffers()[2] or b"") if len(c) else memoryview(b"")
                size = np.diff(at).astype("i4").view(np.uint8).reshape(len(c), 4)
                at = at[edges].tolist()
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    made[k] += [size[a:b].T.tobytes(), data[at[k] : at[k + 1]]]
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                made[k].append(b"" if null is None else null[a:b].tobytes())
        return [squeeze.compress(b"".join(self._head(parts) + parts)) for parts in made]

    @staticmethod
    def _head(parts: list) -> list:
        return [np.array([len(p) for p in parts], "i8").tobytes()]

    def rows(self, bodies: list[bytes], kinds: list[pa.DataType]) -> list[pa.Array]:
        """The columns of some bodies, one after the other."""
        unpack = zstandard.ZstdDecompressor()
        count = sum(2 if wide else 3 for _, wide in self.fields)
        got: list[list] = [[] for _ in range(count)]
        for body in bodies:
            raw = memoryview(unpack.decompress(body))
            at = 8 * count
            for k, n in enumerate(np.frombuffer(raw[:at], "i8").tolist()):
                got[k].append(raw[at : at + n])
                at += n
        out, k = [], 0
        for (_, wide), kind in zip(self.fields, kinds):
            numbers = np.concatenate([np.frombuffer(p, np.uint8).reshape(np.dtype(wide or "i4").itemsize, -1).T for p in got[k]]) if bodies else np.zeros((0, np.dtype(wide or "i4").itemsize), np.uint8)
            values = np.ascontiguousarray(numbers).view(wide or "i4").ravel()
            null = got[k + (1 if wide else 2)]
            if any(len(x) for x in null):
                lengths = [len(p) // np.dtype(wide or "i4").itemsize for p in got[k]]
                mask = np.concatenate([np.frombuffer(x, np.uint8) if len(x) else np.zeros(n, np.uint8) for x, n in zip(null, lengths)]).astype(bool)
            else:
                mask = None
            if wide:
                out.append(pa.array(values, kind, mask=mask))
            else:
                at = np.concatenate(([0], np.cumsum(values, dtype=np.int64))).astype(np.int32)
                c = pa.StringArray.from_buffers(len(values), pa.py_buffer(at), pa.py_buffer(b"".join(got[k + 1])))
                out.append(c if mask is None else pc.if_else(pa.array(mask), pa.scalar(None, pa.string()), c))
            k += 2 if wide else 3
        return out


def whole_pages(tables: list[DataFrame], work: Work, schema: str | T.StructType, rest: Callable[[list[DataFrame]], DataFrame], key: str = "page_id", bounds: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """What work makes of the rows that tables have of each page (value of key); rest makes the same of pages of more than `most` rows, and spreads them.

    bounds (key, n), if it is known without the rows: a page has n of them at most.
    """
    most = MOST if most is None else most
    fields = [[f for f in t.schema.fields if f.name != key] for t in tables]
    if not all(map(Columns.fit, fields)):
        return rest(tables)
    counted = lambda t: t.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    sized = [counted(t) for t in tables] if bounds is None else [bounds.select(F.col(key).alias("__key"), "n")]
    over = [c.filter(F.col("n") > most).select("__key") for c in sized]
    large = materialise(reduce(DataFrame.union, over).distinct())
    some = not large.isEmpty()
    same = F.col(key).eqNullSafe(F.col("__key"))  # large has one row in `most` at most, which is sent to all
    columns = [Columns(f) for f in fields]
    kinds = [[pa.string() if w is None else pa.from_numpy_dtype(np.dtype(w)) for _, w in c.fields] for c in columns]

    def packer(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def packed(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
            ids = t.column(key).combine_chunks().take(pa.array(at[:-1]))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), side, np.int32)), pa.array(np.diff(at).astype(np.int32)), pa.array(columns[side].bodies(t, at), pa.binary())], names=[key, "__side", "__n", "__body"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left: pa.Table | None = None
            for t in gathered(batches, MOST >> 1):
                t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
                at = edges_of(t.column(key))
                if len(at) > 2:
                    yield packed(t.slice(0, at[-2]).combine_chunks(), at[:-1])
                left = t.slice(at[-2]).combine_chunks()
                if left.num_rows > MOST:  # the rest of the page comes in another body
                    yield packed(left, np.array([0, left.num_rows]))
                    left = None
            if left is not None and left.num_rows:
                yield packed(left, np.array([0, left.num_rows]))

        return pack

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done(upto: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held[:] = t.slice(upto).combine_chunks().to_batches()
            ids, side, count = t.column(0).combine_chunks().slice(0, upto), t.column(1).to_numpy()[:upto], t.column(2).to_numpy()[:upto]
            at = edges_of(ids)
            ids, page = ids.take(pa.array(at[:-1])), np.repeat(np.arange(len(at) - 1), np.diff(at))
            got, edges = [], []
            for k, c in enumerate(columns):
                mine = np.flatnonzero(side == k)
                got.append(pa.table(c.rows([t.column(3)[i].as_buffer() for i in mine.tolist()], kinds[k]), names=[f for f, _ in c.fields]))
                edges.append(np.concatenate(([0], np.cumsum(np.bincount(page[mine], count[mine], len(ids)).astype(np.int64)))))
            yield from work(ids, got, edges).combine_chunks().to_batches(8192)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                held.append(part)
                n += sum(part.column(2).to_pylist())
                if n >= MOST:
                    t = pa.Table.from_batches(held)
                    at = edges_of(t.column(0))
                    if len(at) > 2:
                        yield from done(int(at[-2]))
                        n = sum(x for p in held for x in p.column(2).to_pylist())
        if held and sum(p.num_rows for p in held):
            yield from done(sum(p.num_rows for p in held))

    head = T.StructType([tables[0].schema[key], T.StructField("__side", T.IntegerType()), T.StructField("__n", T.IntegerType()), T.StructField("__body", T.BinaryType())])
    dealt = [t.join(F.broadcast(large), same, "left_anti") for t in tables] if some else tables
    bodies = reduce(DataFrame.union, [t.mapInArrow(packer(k), head) for k, t in enumerate(dealt)])
    out = bodies.repartition(key).sortWithinPartitions(key).mapInArrow(unpack, schema)
    return out.unionByName(rest([t.join(F.broadcast(large), same, "left_semi") for t in tables])) if some else out
