"""Long repeated spans across documents, by compaction of a de Bruijn graph of token k-mers.

Windows of `window` words that occur in an earlier document are to go.  A window is an edge
between the nodes of its first and its last window - 1 words; a passage is a path.

1. Inside the tasks that read the texts, neighbouring windows with one anchor (the least hash
   among their k-mers) are put together to a segment: an edge that stands for a dozen
   windows, with the nodes of its first and last.  Equal windows have equal anchors, so edges
   can repeat only where anchors do; anchors that one document has alone are dropped.
2. Edges that several documents have are the graph: one row for each, with its first
   source.  Where one anchor has unlike segments, and only there, windows are edges of their own.
3. Degrees of nodes are counted over the edges.  The edges of a source that follow one
   another over nodes with one way in and one way out are compacted to a path, by joins of
   edges and nodes.
4. Each document's edges are joined to their paths; those that touch are one span.
5. Each span is read at both coordinates and kept only if the words are the same.

Texts are packed in stored blocks, and a row is known by its block and place: texts are never
shuffled by document, and two texts with one id are told apart.  What is shuffled is rows of
segments and requests, and the compressed blocks that are asked for.  What many rows share (the
anchor of a passage that a third of the documents have) is joined in parts (`hub_join`).

Defined cases: a null text has no words; texts shorter than a window lose nothing;
a repeat inside one document, or in documents with one id, is no repeat; documents with
a null id lose nothing and are no source; repeated rows are judged each on its own; a long text is
read whole, and is a block of its own; an empty table gives an empty one; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .blocks import opened, packed
from .tables import aliased, chunks, hub_join, mixed, rolling, stored, utf8, words_of

WINDOW = 50
K = 25
#: Bytes of text in a block; the windows that are asked of one are held at once.
BYTES = 8 << 20
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of `size` values."""
    length, out = 1, values
    while 2 * length <= size:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = size - length
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of rows: first row, row of each word, first word of each row, places of windows; by place anchors, hashes and nodes."""
    for first, last in chunks(offsets):
        words, _, _, before = words_of(data, offsets[first : last + 1], lower=False)
        if len(words) < window:
            continue
        row = np.repeat(np.arange(last - first), np.diff(before))
        places = np.flatnonzero(row[: len(words) - window + 1] == row[window - 1 :])
        if len(places):
            anchors = _least(rolling(words, k), window - k + 1)
            yield first, row, before, places, anchors, rolling(words, window), rolling(words, window - 1)


def blocks_of(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """Stored blocks of documents: id, text and the columns in names, by number."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(names)])
    return packed(rows, lambda batch: batch, size, BYTES)


def _rows(bodies: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of a block, and the place of each one's first row."""
    first = 0
    for batch in opened(bodies):
        yield first, batch
        first += batch.num_rows


def segments(blocks: DataFrame, kind: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """anchor, body (hash of the segment), head and tail (its nodes; equal numbers of unlike nodes only make paths shorter), block, row, id, start (word) and n (windows); ids aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0), batch.column(1)):
                for base, part in _rows([body]):
                    ids = part.column(0)
                    named = ids.is_valid().to_numpy(zero_copy_only=False)
                    for first, row, before, p, anchors, hashes, nodes in _windows(*utf8(part.column(1)), window, k):
                        p = p[named[first + row[p]]]
                        if not len(p):
                            continue
                        new = np.ones(len(p), bool)
                        new[1:] = (anchors[p[1:]] != anchors[p[:-1]]) | (p[1:] != p[:-1] + 1)
                        at = np.arange(len(p))
                        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % (window - k + 1) == 0
                        a = np.flatnonzero(new)
                        n = np.diff(np.append(a, len(p)))
                        start, end = p[a], p[a] + n - 1
                        whole = mixed(hashes[start] * _C1 + hashes[end] * _C2 + n.astype(np.uint64))
                        r = row[start]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x.view(np.int64)) for x in (anchors[start], whole)]
                            + [pa.array((x >> np.uint64(32)).astype(np.int32)) for x in (nodes[start], nodes[end + 1])]
                            + [pa.array(np.full(len(r), block.as_py())), pa.array((base + first + r).astype(np.int32)), ids.take(pa.array(first + r))]
                            + [pa.array((start - before[r]).astype(np.int32)), pa.array(n.astype(np.int32))],
                            names=["anchor", "body", "head", "tail", "block", "row", "id", "start", "n"],
                        )

    return blocks.mapInArrow(run, f"anchor long, body long, head int, tail int, block long, row int, id {kind}, start int, n int")


def compacted(edges: DataFrame) -> DataFrame:
    """edges (anchor, body, head, tail, n, s: its source) with path, the place in the source where its path begins.

    An edge goes on with the path of the one before it in its source if they meet in a node
    that no other edge leaves or enters.
    """
    ends = edges.select(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("tail", F.lit(0), F.lit(1)))
    simple = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 and i = 1").select("node")
    inner = edges.join(simple, edges["head"] == simple["node"], "left")
    along = Window.partitionBy("s.block", "s.row").orderBy("s.start", "n", "body")
    before = F.lag(F.struct("tail", (F.col("s.start") + F.col("n")).alias("next"))).over(along)
    goes_on = F.col("node").isNotNull() & (before["tail"] == F.col("head")) & (before["next"] == F.col("s.start"))
    begins = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("s.start"))
    path = F.last(begins, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return inner.withColumn("path", path).select("anchor", "body", "s", "path")


def repeated_spans(blocks: DataFrame, kind: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """Verified spans (block, row, start, length), in words."""
    every = stored(segments(blocks, kind, window, k))
    shared = every.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor")
    own = stored(hub_join(every, shared, "anchor", every))
    source = F.min(F.struct("id", "block", "row", "start")).alias("s")
    bodies = own.groupBy("anchor", "body").agg(source, F.max("id").alias("last"), F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("n").alias("n"))
    bodies = stored(bodies)

    # Where one anchor has unlike segments, windows are edges of their own.
    branches = bodies.groupBy("anchor").agg(F.min("body").alias("x"), F.max("body").alias("y")).filter("x < y").select("anchor")
    first = bodies.join(branches, "anchor").select("anchor", "body", F.col("s.id").alias("first"))
    firsts = hub_join(own, first, "anchor", own, ("body",)).filter("id = first")  # the others are equal to an earlier one
    firsts = firsts.select("anchor", "block", "row", "start", "n")

    def expand(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        ids = []
        asked = asked.sort_by([("row", "ascending"), ("start", "ascending")]) if asked.num_rows else asked
        rows, start, n, anchor = (asked[c].to_numpy() for c in ("row", "start", "n", "anchor"))
        for base, part in _rows(texts["body"]) if len(rows) else ():
            for first, row, before, p, _, hashes, nodes in _windows(*utf8(part.column(1)), window, k):
                a, b = np.searchsorted(rows, (base + first, base + first + len(before) - 1))
                if a == b:
                    continue
                m, r = n[a:b].astype(np.int64), rows[a:b] - base - first
                at = np.repeat(start[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
                place = np.repeat(before[r], m) + at
                for x, v in zip(out, (np.repeat(anchor[a:b], m), hashes[place].view(np.int64), (nodes[place] >> np.uint64(32)).astype(np.int32), (nodes[place + 1] >> np.uint64(32)).astype(np.int32), np.repeat(rows[a:b], m).astype(np.int32), at.astype(np.int32))):
                    x.append(v)
                ids.append(part.column(0).take(pa.array(np.repeat(first + r, m))))
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
        anchor, h, head, tail, row, at = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, kinds))
        block = np.full(len(h), asked["block"][0].as_py() if len(h) else 0)
        return pa.table({"anchor": anchor, "body": h, "head": head, "tail": tail, "block": block, "row": row, "id": pa.concat_arrays(ids) if ids else pa.nulls(0, texts_kind), "start": at, "n": np.ones(len(h), np.int32)})

    texts_kind = to_arrow_type(every.schema["id"].dataType)
    single = blocks.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(expand, every.schema)
    single = stored(single)
    windows = single.groupBy("anchor", "body").agg(source, F.max("id").alias("last"), F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("n").alias("n"))
    edges = compacted(stored(bodies.union(windows).filter("s.id < last").drop("last")))

    # Compaction of what the documents have: neighbours on one path, at one shift, that touch are one span.
    seen = own.select("anchor", "body", "block", "row", "id", "start", "n").union(single.select("anchor", "body", "block", "row", "id", "start", "n"))
    found = hub_join(seen, edges, "anchor", own, ("body",)).filter("s.id < id")
    found = found.select("block", "row", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"), F.col("s.block").alias("to_block"), F.col("s.row").alias("to_row"), "path", (F.col("start") - F.col("s.start")).alias("shift"))
    along = Window.partitionBy("block", "row", "to_block", "to_row", "path", "shift").orderBy("start")
    found = found.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    found = found.withColumn("part", F.sum("new").over(along))
    found = found.groupBy("block", "row", "to_block", "to_row", "path", "shift", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = found.select("block", "row", "start", (F.col("end") - F.col("start")).alias("length"), "to_block", "to_row", (F.col("start") - F.col("shift")).alias("to_start"))
    spans = stored(spans.withColumn("at", F.xxhash64("to_block", "to_row", "to_start", "length")))

    # Verification at both coordinates; a source's span is read once, however many documents repeat it.
    places = spans.select("block", "row", "start", "length").union(spans.select("to_block", "to_row", "to_start", "length")).distinct()

    def read(texts: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("row") if asked.num_rows else asked
        rows, start, length = (asked[c].to_numpy() for c in ("row", "start", "length"))
        digest: list[bytes] = []
        for base, part in _rows(texts["body"]) if len(rows) else ():
            a, b = np.searchsorted(rows, (base, base + part.num_rows))
            row = -1
            for i in range(a, b):
                if rows[i] != row:
                    row = rows[i]
                    words = (part.column(1)[int(row - base)].as_py() or "").encode().split()
                digest.append(hashlib.blake2b(b" ".join(words[start[i] : start[i] + length[i]]), digest_size=16).digest())
        return asked.select(["block", "row", "start", "length"]).append_column("digest", pa.array(digest, pa.binary()))

    digests = stored(blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(read, "block long, row int, start int, length int, digest binary"))
    at_source = digests.select(F.xxhash64("block", "row", "start", "length").alias("at"), F.col("block").alias("to_block"), F.col("row").alias("to_row"), F.col("start").alias("to_start"), "length", F.col("digest").alias("source_digest"))
    both = hub_join(spans.join(digests, ["block", "row", "start", "length"]), at_source, "at", spans, ("to_block", "to_row", "to_start", "length"))
    return both.filter("digest = source_digest").select("block", "row", "start", "length")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, the text without the repeats.

    A text that loses nothing stays as it is; of others the words that are left are joined by
    one space.  Columns of docs with those names are replaced.
    """
    names = [c for c in docs.columns if c not in (key, text, "n_words", "n_removed", "kept_sha256")] if with_text else []
    blocks = blocks_of(docs, key, text, names)
    spans = repeated_spans(blocks, docs.schema[key].dataType.simpleString(), window, k)
    fields = [T.StructField(key, docs.schema[key].dataType)]
    if with_text:
        fields += [T.StructField(text, T.StringType()), *(docs.schema[c] for c in names)]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    columns = [f.name for f in fields]

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.sort_by("row") if spans.num_rows else spans
        rows, start, length = (spans[c].to_numpy() for c in ("row", "start", "length"))
        out = []
        for base, part in _rows(texts["body"]):
            edges = np.searchsorted(rows, np.arange(base, base + part.num_rows + 1))
            n, gone, digest, texts_ = [], [], [], []
            for i, t in enumerate(part.column(1)):
                t = t.as_py()
                words = (t or "").encode().split()
                left = words
                if edges[i] < edges[i + 1]:
                    keep = np.ones(len(words), bool)
                    for a, m in zip(start[edges[i] : edges[i + 1]].tolist(), length[edges[i] : edges[i + 1]].tolist()):
                        keep[a : a + m] = False
                    left = [w for w, x in zip(words, keep.tolist()) if x]
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts_.append(t if len(left) == len(words) else joined.decode())
            arrays = [part.column(0), *([pa.array(texts_, pa.string()), *part.columns[2:]] if with_text else [])]
            out.append(pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=columns))
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, T.StructType(fields))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated spans removed from their texts, and n_chars in step; documents of which nothing is left go.  Other columns are the caller's."""
    inner, names = aliased(docs)
    text = names["text"]
    out = remove_repeats(inner, key=names["doc_id"], text=text).filter("n_removed = 0 or n_removed < n_words")
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(text).cast("long"))
    return out.select(*[F.col(a).alias(c) for c, a in names.items()])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
