"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenised and cut into pieces of at most `capacity` tokens.  Only
the histogram of piece lengths (at most `capacity` rows, whatever the input) goes
to the driver.  There the configuration LP - cover every length's count with as
few full sequences as possible - is solved by multiplicative weights: each length
has a price, a knapsack by dynamic programming finds the configuration that is
worth most at these prices, and the prices of what it covers fall.  Steps are rounded
down to whole sequences as they are taken, so prices answer to what rounding left.
The last REST of the tokens is packed best-fit-decreasing on the histogram, and
where all of it packed so takes fewer sequences, that is the plan.
Rounds depend on the lengths and on STEP, not on the counts.

The plan says, for each length, which ranks go where.  Ranks come from counts per
(length, bucket of documents), so no length is numbered in one task.

Defined cases: a null text counts as empty and gives one piece, the end id; an
empty table gives no pieces; a long text is cut into as many pieces as it needs; null ids
are ids like others; other columns don't matter; repeated rows are packed each on its own; equal
lengths are ranked by document and piece.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored, utf8

CAPACITY = 4096
END = 1
#: Encoded words, and encoded parts of words, that a task keeps; beyond that a table starts anew, and takes over what comes again.
CACHED_WORDS, CACHED_PARTS = 300_000, 300_000
#: Pieces for each bucket of ranks.
BUCKET = 20_000
#: The linear program: the share of a length that a round covers, the share of tokens it leaves to
#: best fit, the rounds that large counts take, roughly, and the lengths that one knapsack looks at.
STEP, REST, ROUNDS, DRAWN = 0.3, 0.02, 4096, 64
#: How fast prices fall: slowly, where many lengths fill a sequence; fast, where few do.  The second, and then both
#: without the longest length in each configuration, are tried where a gap of more than NEAR is left to the lower bound.
RATES, NEAR = (0.3, 2.0), 0.002

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
#: A few ids as little-endian unsigned 32-bit numbers.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_KNOWN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")  # these characters lower-case and split in ways that _PARTS states


class Kept(dict):
    """What make gives for a key, as long as the table before it or this one has it; at most `most` in each."""

    def __init__(self, make: Callable[[str | bytes], bytes], most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.before.get(key) or self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Tokens:
    """A word-level vocabulary: words between ASCII white space are encoded one by one, each only once.

    The normaliser and the splitter of such a vocabulary never look across white space.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model  # the attribute makes a new object each time
        state = re.sub(r"\s", "", self.whole.to_str(pretty=False)[:4000])
        self.by_word = '"NFC"' in state and '"Lowercase"' in state and '"invert":true' in state and '"add_prefix_space":false' in state
        self.words, self.parts = Kept(self.word, CACHED_WORDS), Kept(self._part, CACHED_PARTS)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([self.alphabet[b] for b in part.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self.parts[word.lower().decode()]
        head, last = word[:-1], word[-1:]
        if head.isalpha() and b" " < last < b"\x7f":  # and one sign or digit, which is a part of its own
            return self.parts[head.lower().decode()] + self.parts[last.decode()]
        text = word.decode()
        if text.isalpha() and (len(text) == len(word) or max(text) <= "ÿ"):
            return self.parts[text.lower()]
        if "<|" not in text and _KNOWN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))

    def forget(self) -> None:
        """Empties the tables."""
        for table in (self.words, self.parts):
            table.clear()
            table.before = {}


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32 (and ids, when asked for)."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(model)
        stop = np.array([END], "<u4").tobytes()
        try:
            for batch in batches:
                data, at = utf8(batch.column(1))
                data = memoryview(data)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(batch.num_rows):
                    whole = t.ids(bytes(data[at[i] : at[i + 1]])) + stop
                    for k, first in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[first : first + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (start, length, crc)]
                    + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                    names=[key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
                )
        finally:
            t.forget()  # idle workers outlive their tasks, and an executor has as many as tasks ever ran at once

    return source.mapInArrow(run, schema)


# ------------------------------------------------------------ the plan, on the histogram of lengths


def knapsack(lengths: np.ndarray, copies: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration worth most, with at most `copies` of each length: how often it has each.  Dynamic programming over the room."""
    item, times = [], []
    for i, n in enumerate(np.minimum(copies, capacity // lengths).tolist()):
        part = 1
        while n > 0:  # 1, 2, 4, ... copies and the rest are one item each
            item.append(i), times.append(min(part, n))
            n, part = n - part, 2 * part
    size = (lengths[item] * times).tolist()
    value = (prices[item] * times).tolist()
    worth = np.zeros(capacity + 1)
    took = np.zeros((len(item), capacity + 1), bool)
    for k, (w, v) in enumerate(zip(size, value)):
        other = worth[: capacity + 1 - w] + v
        np.greater(other, worth[w:], out=took[k, w:])
        np.maximum(worth[w:], other, out=worth[w:])
    config, room = np.zeros(len(lengths), np.int64), capacity
    for k in range(len(item) - 1, -1, -1):
        if took[k, room]:
            config[item[k]] += times[k]
            room -= size[k]
    return config


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float, longest: bool, step: float = STEP, rest: float = REST, seed: int = 1) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations with how many sequences take each, by multiplicative weights, and the counts that are left.

    The price of a length starts at its share of a sequence and falls by exp(-rate) as all of it
    is covered.  A round finds the configuration worth most by a knapsack over lengths drawn by
    price (all, if few), and takes it for `step` of what its scarcest length has left, or for one
    in ROUNDS of all sequences, rounded down to whole ones, but for one at least; so the cover
    is whole numbers throughout.  With `longest` a configuration has the longest length left, which fewest others
    go with, and the knapsack fills the room beside it.  It ends when no more than `rest` of the tokens is left.
    """
    random = np.random.default_rng(seed)
    left, used = counts.copy(), []
    total = tokens = int(lengths @ counts)
    finest = total // capacity // ROUNDS
    while tokens > rest * total:
        prices = lengths / capacity * np.exp(rate * (left / counts - tokens / total))
        some = np.flatnonzero(left)
        first, room, free = some[-1], capacity, left.copy()
        if longest:
            room, free[first] = capacity - int(lengths[first]), left[first] - 1
            some = np.flatnonzero(free[: int(np.searchsorted(lengths, room, "right"))])
        if len(some) > DRAWN:
            share = prices[some] / lengths[some]
            some = some[np.argsort(random.exponential(size=len(some)) / share)[:DRAWN]]
        copies = np.minimum(free[some], 3) if len(some) == DRAWN else free[some]  # of many lengths, none is needed often
        all_few = np.zeros(len(lengths), np.int64)
        if len(some):
            all_few[some] = knapsack(lengths[some], copies, prices[some], room)
        all_few[first] += longest
        some = np.flatnonzero(all_few)
        few = all_few[some]
        most = int((left[some] // few).min())
        times = max(1, int(step * most), min(most, finest))
        left[some] -= times * few
        tokens -= int(lengths[some] @ few) * times
        used.append((dict(zip(lengths[some].tolist(), few.tolist())), times))
    return used, left


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the sequences needed, from dual prices: for a limit a, pieces longer than capacity - a go
    alone, longer than half of it go one to a sequence, and those of at least a fill what room these leave."""
    count = np.bincount(list(histogram), list(histogram.values()), capacity + 1)
    number, tokens = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    a = np.arange(capacity // 2 + 1)
    top, half = capacity - a, capacity // 2
    alone = number[-1] - number[top]
    mates, in_mates = number[top] - number[half], tokens[top] - tokens[half]
    small = tokens[half] - np.where(a > 0, tokens[np.maximum(a - 1, 0)], 0)
    return int(np.max(alone + mates + np.maximum(0, np.ceil((small - (mates * capacity - in_mates)) / capacity))))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, from_program: list[int] | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: how many} with how many sequences have each; together they hold the histogram exactly.

    from_program gets the number of sequences whose configuration the linear program gave.
    """
    wanted = {n: c for n, c in histogram.items() if c > 0}
    lengths = np.array(sorted(wanted), np.int64)
    counts = np.array([wanted[n] for n in lengths], np.int64)
    if not wanted:
        return []
    best: tuple = ()
    for longest, rate in ((x, r) for x in (True, False) for r in RATES):
        used, left = solve(lengths, counts, capacity, rate, longest)
        n = sum(n for _, n in used)
        out = used + best_fit(lengths, left, capacity)
        if not best or sum(n for _, n in out) < best[0]:
            best = sum(n for _, n in out), n, out
        if best[0] <= (1 + NEAR) * least_sequences(wanted, capacity):
            break
    alone = best_fit(lengths, counts, capacity)
    if sum(n for _, n in alone) < best[0]:
        best = sum(n for _, n in alone), 0, alone
    if from_program is not None:
        from_program.append(best[1])
    return best[2]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: the longest left opens a sequence, the longest that fits follows; the same filling is repeated while counts allow."""
    counts = counts.copy()
    alive = np.flatnonzero(counts)
    out = []
    while len(alive):
        config: dict[int, int] = {}
        room, top = capacity, len(alive)
        while top:
            top = int(np.searchsorted(lengths[alive[:top]], room, "right"))
            if not top:
                break
            k = alive[top - 1]
            n = min(int(counts[k]), room // int(lengths[k]))
            if n > 1 and len(alive) > 1:
                n = max(1, n // 2)  # leave some for gaps that only this length fills
            config[k] = config.get(k, 0) + n
            room -= n * int(lengths[k])
            if config[k] >= counts[k] or n * lengths[k] <= room:
                top -= 1
        times = max(1, min(int(counts[k]) // n for k, n in config.items()))
        for k, n in config.items():
            counts[k] -= n * times
        out.append(({int(lengths[k]): n for k, n in config.items()}, times))
        alive = alive[counts[alive] > 0]
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """found (key, piece, length, ...) with sequence_id and offset.  It is read three times: pass a stored table.

    Every length must be from 1 to capacity.
    """
    spark = found.sparkSession
    total = found.count()
    buckets = max(1, total // BUCKET)
    rows = found.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows

    length, first, copies, sequence, offset = [], [], [], [], []
    taken: dict[int, int] = {}
    number = 0
    for config, times in plan(histogram, capacity):
        place = 0
        for size, n in sorted(config.items(), reverse=True):
            for x, v in ((length, size), (first, taken.get(size, 0)), (copies, n), (sequence, number), (offset, place)):
                x.append(v)
            taken[size] = taken.get(size, 0) + times * n
            place += size * n
        number += times
    order = np.lexsort((np.array(first, np.int64), np.array(length, np.int64)))
    slots = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (length, first, copies, sequence, offset)])

    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(key, "piece", *[c for c in ("start", "ids_crc32") if c in found.columns])) - 1
    ranked = rows.withColumn("__rank", rank).join(firsts.drop("__n"), ["length", "__bucket"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in found.columns], (F.col("__first") + F.col("__rank")).cast("long").alias("__rank"))
    names, types = found.columns, [*found.schema.fields]
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, copies, sequence, offset = slots.value
        keys = length * (1 << 40) + first
        for batch in batches:
            size = batch.column(at).to_numpy().astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy()
            s = np.searchsorted(keys, size * (1 << 40) + rank, "right") - 1
            n = rank - first[s]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[s] + n // copies[s]), pa.array(offset[s] + n % copies[s] * size)],
                names=[*names, "sequence_id", "offset"],
            )

    import pyspark.sql.types as T

    return ranked.mapInArrow(place, T.StructType([*types, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def tokenise_and_pack(docs: DataFrame, model: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(docs, model, capacity)), capacity)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenise_and_pack(docs, model or model_path("word_bpe_49k.json"))
