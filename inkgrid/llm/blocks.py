"""Blocks of rows: packed by the tasks that read them, stored once, and answered block by block.

A block holds neighbouring rows of one partition, up to a number of bytes, so no key decides
where a row goes and no block outgrows the others, whatever is repeated.  Blocks are stored,
so a job that comes back to them, or is run again, finds the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tables import stored

#: Bytes in a block, and the least number of blocks to which many small partitions are put together.
BLOCK = 16 << 20
LEAST = 16


def cut(batch: pa.RecordBatch, limit: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a batch, at most so many and of at most limit bytes, or one row."""
    if batch.num_rows > rows or (batch.num_rows > 1 and batch.nbytes > limit):
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), limit, rows)
        yield from cut(batch.slice(half), limit, rows)
    elif batch.num_rows:
        yield batch


def packed(rows: DataFrame, convert: Callable[[pa.RecordBatch], pa.RecordBatch], size: int, limit: int = BLOCK, least: int = LEAST) -> DataFrame:
    """block, body: what convert makes of rows, in blocks.  size: bytes of all rows, roughly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5)
        number = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as w:
                for part in parts:
                    w.write_batch(part)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], names=["block", "body"])
            parts.clear()
            number, held = number + 1, 0
            return out

        for batch in batches:
            for part in cut(batch, limit // 4):
                part = convert(part)
                if held and held + part.nbytes > limit:
                    yield block()
                parts.append(part)
                held += part.nbytes
        if parts:
            yield block()

    return stored(rows.coalesce(max(least, -(-size // limit))).mapInArrow(run, "block long, body binary"))


def opened(bodies: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for body in bodies:
        with pa.ipc.open_stream(unpack.decompress(body.as_buffer())) as r:
            yield from r


def squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as compressed planes of bytes; ascending ones by their steps."""
    v = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes())


def unsqueezed(body: bytes | pa.Buffer, kind: type, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    planes = planes.reshape(size, -1)
    if size == 4:  # put together by shifts, which is quicker than to turn the table
        v = planes[3].astype(np.uint32)
        for plane in planes[2::-1]:
            v <<= np.uint32(8)
            v |= plane
        v = v.view(kind)
    else:
        v = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(v, dtype=v.dtype) if ascending else v


class Sums:
    """Distinct keys and the sums of their counts, merged as they come in, so that no more than about twice the result is held."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: distinct."""
        self.more.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        k = np.concatenate([self.keys, *(m[0] for m in self.more)])
        c = np.concatenate([self.counts, *(m[1] for m in self.more)])
        self.more, self.waiting = [], 0
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        del order
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        self.keys, self.counts = k[new], (np.add.reduceat(c, new) if len(k) else c)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        return self.keys, self.counts
