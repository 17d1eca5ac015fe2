"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map: at each place the
longest key of its double-array trie is replaced, and every byte written records
the byte of the source it came from.  The processor cuts the normalised text into
pieces; their lengths, summed up, give each piece's place in the normalised text,
and the recorded alignment projects it to a span of bytes of the source.

The model is a file on every executor; its path is a parameter.

Defined cases: a null text counts as empty; an empty text has no pieces, only the
end id; a long text is encoded whole, in its task's memory; an empty table gives an empty one; null and repeated
ids don't matter; extra columns, whatever their names, pass through; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import unused, utf8

SPACE = "▁".encode()  # what the library writes for a space
UNKNOWN, BYTE = 2, 6  # kinds of pieces in the model file
#: Encoded words that a task keeps; the table starts anew beyond that.
CACHED = 200_000

COLUMNS = {
    "ids": pa.list_(pa.int32()),
    "begins": pa.list_(pa.int32()),
    "ends": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "n_tokens": pa.int64(),
    "n_source_bytes": pa.int64(),
    "spans_crc32": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_SQL = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string", "n_tokens": "long", "n_source_bytes": "long", "spans_crc32": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class Normaliser:
    """Longest-prefix normalisation with the compiled character map of a model, and the source of every byte written."""

    def __init__(self, model: bytes):
        self.prefix = self.trim = self.escape = True
        self.suffix = False
        blob, user = b"", []
        for field, value in _fields(model):
            if field == 3:
                for f, v in _fields(value):
                    if f == 2:
                        blob = v
                    elif f in (3, 4, 5):
                        setattr(self, {3: "prefix", 4: "trim", 5: "escape"}[f], bool(v))
            elif field == 2:
                self.suffix = any(f == 24 and v for f, v in _fields(value))
            elif field == 1:
                piece = dict(_fields(value))
                if piece.get(3) == 4:
                    user.append(piece[1])
        self.user = sorted(user, key=len, reverse=True)
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.strings = blob[4 + size :]
        self.plain = not self.units and not self.user and not self.trim and not self.suffix

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that text has at this place, and the key's length."""
        units = self.units
        if not units:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & 512) >> 6)

        node, found, size = offset(units[0]), None, 0
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found, size = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.strings[found : self.strings.index(b"\0", found)], size

    def step(self, text: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.user:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        if found := self.longest(text, at):
            return found
        size = 1
        while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
            size += 1
        return text[at : at + size], size

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text; for each of its bytes, and its end, the place in the source."""
        space = SPACE if self.escape else b" "
        if self.plain:
            return self._plain(text, space)
        out, source, at = bytearray(), [], 0
        if self.trim:
            while at < len(text) and (part := self.step(text, at))[0] == b" ":
                at += part[1]
        if at == len(text):
            return b"", np.zeros(1, np.int64)

        def add(b: bytes) -> None:
            out.extend(b)
            source.extend([at] * len(b))

        if self.prefix and not self.suffix:
            add(space)
        after_space = self.trim
        while at < len(text):
            part, size = self.step(text, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                add(part.replace(b" ", space))
                after_space = part.endswith(b" ")
            at += size
            if not self.trim:
                after_space = False
        if self.trim:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            add(space)
        return bytes(out), np.array([*source, at], np.int64)

    def _plain(self, text: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """Without a character map only spaces change, so whole arrays do the work of the loop."""
        if not text:
            return b"", np.zeros(1, np.int64)
        b = np.frombuffer(text, np.uint8)
        source = np.where(b & 0xC0 != 0x80, np.arange(len(b)), 0)
        np.maximum.accumulate(source, out=source)
        head = len(space) if self.prefix else 0
        if self.escape:
            source = np.repeat(source, np.where(b == 32, len(space), 1))
            text = text.replace(b" ", space)
        return (space if head else b"") + text, np.concatenate((np.zeros(head, np.int64), source, [len(b)]))


class Codec:
    """A model, loaded once in a worker."""

    def __init__(self, path: str):
        import sentencepiece

        model = open(path, "rb").read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser(model)
        pieces = [dict(_fields(v)) for f, v in _fields(model) if f == 1]
        self.size = np.array([1 if p.get(3, 1) == BYTE else len(p[1]) for p in pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(pieces) if p.get(3, 1) == UNKNOWN), -1)
        # No piece has a space after another character: then words are encoded one by one, and each only once.
        self.by_word = self.normaliser.plain and self.normaliser.prefix and self.normaliser.escape and not any(SPACE in p[1].lstrip(SPACE) for p in pieces)
        self.words: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> np.ndarray:
        """Without the end id."""
        if not text:
            return np.zeros(0, np.int32)
        words = text.split(b" ")
        if not self.by_word or b"" in words or SPACE in text:
            return np.array(self.processor.encode(text.decode()), np.int32)
        known = self.words
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), np.int32)
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            for w, ids in zip(new, self.processor.encode([w.decode() for w in new], num_threads=1)):
                known[w] = np.array(ids, np.int32).tobytes()
        return np.frombuffer(b"".join([known[w] for w in words]), np.int32)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins and ends in the bytes of the text; the whole text for each, if the pieces aren't those of the normalised text."""
        normal, source = self.normaliser(text)
        size = self.size[ids]
        if self.unknown in ids:
            pieces = self.processor.encode(text.decode(), return_type="proto").pieces
            size = np.array([len(p.piece.encode()) if i == self.unknown else n for p, i, n in zip(pieces, ids, size)], np.int64)
        end = np.cumsum(size)
        if len(end) and end[-1] != len(normal):
            return np.zeros(len(end), np.int64), np.full(len(end), len(text), np.int64)  # all that is known is the text
        return source[end - size], source[end]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids", "begins", "ends"), text: str = "text") -> DataFrame:
    """docs with the outputs of COLUMNS that are asked for (columns with those names are replaced).

    ids end with the model's end id, whose span is empty, at the end of the text; begins and ends
    are byte places in the UTF-8 text; decoded is what the ids decode to; n_source_bytes are the
    bytes of the text that the spans cover; spans_crc32 is that of the begins and the ends, as 32-bit numbers.
    """
    import pyspark.sql.types as T

    kept = [f for f in docs.schema.fields if f.name not in outputs]
    schema = T.StructType([*kept, *(T.StructField(c, T._parse_datatype_string(_SQL[c])) for c in outputs)])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text), F.lit("")).alias(unused("__text", [f.name for f in kept])))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        stop = c.processor.eos_id()
        for batch in batches:
            data, at = utf8(batch.column(len(names)))
            data = memoryview(data)
            for first in range(0, max(1, batch.num_rows), 256):
                n = min(256, batch.num_rows - first)
                out: dict[str, list] = {name: [] for name in outputs}
                for i in range(first, first + n):
                    t = bytes(data[at[i] : at[i + 1]])
                    ids = c.ids(t)
                    row = {"n_tokens": len(ids) + 1}
                    whole = np.append(ids, np.int32(stop))
                    if {"begins", "ends", "n_source_bytes", "spans_crc32"} & set(outputs):
                        begin, end = c.spans(t, ids)
                        row |= {"begins": np.append(begin, len(t)).astype(np.int32), "ends": np.append(end, len(t)).astype(np.int32), "n_source_bytes": int((end - begin).sum())}
                        row["spans_crc32"] = zlib.crc32(row["ends"].tobytes(), zlib.crc32(row["begins"].tobytes()))
                    if {"ids", "ids_sha256"} & set(outputs):
                        row["ids"] = whole
                    listed = whole.tolist()
                    if "ids_sha256" in outputs:
                        row["ids_sha256"] = hashlib.sha256(" ".join(map(str, listed)).encode()).hexdigest()
                    if {"decoded", "decoded_sha256"} & set(outputs):
                        row["decoded"] = c.processor.decode(listed)
                        row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
                    for name in outputs:
                        out[name].append(row[name])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, n) for k in range(len(names))] + [pa.array(out[name], COLUMNS[name]) for name in outputs],
                    names=[*names, *outputs],
                )

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """encoded with the text that its ids decode to; null ids decode to null."""

    @F.pandas_udf("string")
    def text(column):
        p = codec(model).processor
        return column.map(lambda x: None if x is None else p.decode([int(i) for i in x]))

    return encoded.withColumn(output, text(F.col(ids)))


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, model or model_path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_crc32"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_crc32")
