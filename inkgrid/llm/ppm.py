"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is the trie of byte contexts up to `order`, with counts from the training
texts.  A symbol is coded in its longest known context; where it is new there, an
escape is coded (method D: each distinct symbol seen takes half a count for it) and the next
shorter context tries, without the symbols that the longer one has ruled out.  The code
lengths add up to the log-probability of the text and its end.

No machine holds the whole trie.  Texts are packed in blocks; a block sends its
distinct (context, symbol) pairs with counts to shards, by the two latest bytes of the
context, or by three where the two are common (the counts of what follows a common pair are
sent to all; at most HOT pairs are).  A shard has every longer context that ends in these
bytes, so it can turn counts into probabilities on its own; the table of contexts of at most
one byte (at most 257 * 257 counts) is sent to all.  Each block gets back the probabilities
of its own pairs and adds them up by document.  Words, for the base score, go the same way.
So what is shuffled is, for each block, its distinct pairs, not its bytes.

Defined cases: a null text counts as empty and is scored for its end alone; a very long text
is coded in parts, with its context, so it needs no more memory than its bytes three times
over (and a single word of megabytes eight times its own); the trained share may be empty
(then all is uniform); repeated rows are scored, and learnt from, each on its own; documents
with a null id are learnt from and scored; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, Sums, opened, packed, squeezed, unsqueezed
from .tables import _LOWER, _SPACE, chunks, mixed, stored, utf8, words_of

ORDER = 5
END = 256  # the symbol after the last byte, and before the first
SYMBOLS = 257
BITS = 9
#: Symbols that are coded at once inside a task.
STEP = 2 << 20
#: Pairs of bytes that are more than one in so many are split by a third byte.
HOT = 256
END_TOKEN = np.int64(0)  # the key of the token after the last word
GRAM, TOKEN, STATS = 0, 1, 2


def _mask(n: int) -> int:
    return (1 << BITS * n) - 1


# ------------------------------------------------------------ the trie of one text, or of a few


class Trie:
    """PPM in dictionaries: adaptive scoring of single texts, and the measure that the shards are tested against."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], Counter[int]] = defaultdict(Counter)

    def cost(self, history: tuple[int, ...], symbol: int) -> float:
        """log10 of the symbol's probability."""
        out, excluded = 0.0, set()
        for j in range(min(self.order, len(history)), -1, -1):
            seen = self.counts.get(history[len(history) - j :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            total = sum(left.values())
            if not total:
                continue
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * total))
            out += math.log10(len(left) / (2 * total))
            excluded |= set(seen)
        return out - math.log10(SYMBOLS - len(excluded))

    def learn(self, history: tuple[int, ...], symbol: int) -> None:
        for j in range(min(self.order, len(history)) + 1):
            self.counts[history[len(history) - j :]][symbol] += 1

    def score(self, text: bytes, learn: bool) -> float:
        history, out = (END,) * self.order, 0.0
        for s in [*text, END]:
            out += self.cost(history, s)
            if learn:
                self.learn(history, s)
            history = (*history, s)[1:] if self.order else ()
        return out


def adaptive_scores(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score: each text coded with a trie that starts empty and learns as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [Trie(order).score((t.as_py() or "").encode().translate(bytes(_LOWER)), True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


# ------------------------------------------------------------ counts of many texts


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of consecutive rows, each row with its end, and where each row begins."""
    n = len(offsets) - 1
    first = offsets - offsets[0] + np.arange(n + 1)
    s = np.full(int(first[-1]), END, np.uint16)
    body = np.ones(len(s), bool)
    body[first[1:] - 1] = False
    s[body] = _LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    return s, first


def _codes(s: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Codes of (context, symbol), STEP symbols at once: codes, the row of the first of them, and how many each row has."""
    for a in range(0, len(s), STEP):
        b = min(a + STEP, len(s))
        r = int(np.searchsorted(first, a, "right")) - 1
        starts = first[r : int(np.searchsorted(first, b))]
        size = np.minimum(first[r + 1 : r + 1 + len(starts)], b) - np.maximum(starts, a)
        back = np.arange(a, b) - np.repeat(starts, size)
        code = s[a:b].astype(np.int64)
        for k in range(1, order + 1):
            lead = min(max(k - a, 0), b - a)
            before = np.concatenate((np.full(lead, END, np.uint16), s[a - k + lead : b - k])) if lead else s[a - k : b - k]
            code |= np.where(back >= k, before, np.uint16(END)).astype(np.int64) << BITS * k
        yield code, r, size


def _words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Keys of the words and the end of each row, some rows or a part of a long one at once: keys, first row, and how many each row has."""
    for r, last in chunks(offsets):
        at, stop = int(offsets[r]), int(offsets[last])
        if last - r == 1 and stop - at > STEP:  # a long text goes in parts that end at white space
            while at < stop:
                cut = min(at + STEP, stop)
                if cut < stop:
                    space = np.flatnonzero(_SPACE[data[at:cut]])
                    if len(space):
                        cut = at + int(space[-1]) + 1
                    else:  # inside a word of that length, which is taken whole
                        while cut < stop and not _SPACE[data[cut]]:
                            cut += 1
                words = words_of(data, np.array([at, cut]), lower=True)[0]
                keys = np.maximum((words >> np.uint64(1)).astype(np.int64), 1)
                if cut == stop:
                    keys = np.append(keys, END_TOKEN)
                yield keys, r, np.array([len(keys)])
                at = cut
            continue
        words, _, _, before = words_of(data, offsets[r : last + 1], lower=True)
        n = last - r
        keys = np.full(len(words) + n, END_TOKEN, np.int64)
        keys[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(before))] = np.maximum((words >> np.uint64(1)).astype(np.int64), 1)
        yield keys, r, np.diff(before) + 1


def _row_sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    out, some = np.zeros(len(size), values.dtype), size > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out


def blocks_of(docs: DataFrame, key: str, text: str, held_out: Column) -> tuple[DataFrame, int]:
    """Stored blocks of documents (key, held, text), and how many there are, roughly."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return packed(rows, lambda batch: batch, size), max(1, -(-size // BLOCK))


def _training(bodies: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in opened(bodies):
        yield utf8(batch.filter(pc.invert(batch["held"]))["text"])


def _collected(blocks: DataFrame, count, size: int) -> np.ndarray:
    """Sums of the arrays of `size` numbers that count makes of training symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for texts in _training(batch.column(0)):
                total += count(*_symbols(*texts))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for at, n in blocks.select("body").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # at most `size` rows
        out[at] = n
    return out


def short_contexts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of (byte before, symbol), at most 257 * 257, and the common pairs of bytes (at most HOT) with the counts of what follows each."""

    def pairs_in(s: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 2 * BITS, np.int64)
        for code, _, _ in _codes(s, first, 1):
            out += np.bincount(code, minlength=len(out))
        return out

    pairs = _collected(blocks, pairs_in, 1 << 2 * BITS)
    hot = np.flatnonzero(pairs * HOT > max(1, pairs.sum()))
    place = np.full(1 << 2 * BITS, -1, np.int64)
    place[hot] = np.arange(len(hot))

    def follow(s: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(max(1, len(hot)) << BITS, np.int64)
        for code, _, _ in _codes(s, first, 2):
            at = place[code >> BITS]
            some = at >= 0
            out += np.bincount(at[some] << BITS | code[some] & _mask(1), minlength=len(out))
        return out

    return pairs, hot, (_collected(blocks, follow, len(hot) << BITS) if len(hot) else np.zeros(0, np.int64)).reshape(-1, 1 << BITS)


def log_probabilities(code: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int, hot: np.ndarray | None = None, follow: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each distinct (context, symbol) code.

    n: its count in training.  The codes must hold every trained code whose context ends in the
    same two bytes, or three where the two are a hot pair, whose own counts are in follow.
    pairs: counts of (byte before, symbol).
    """
    out = np.zeros(len(code))
    open_ = np.ones(len(code), bool)
    above: tuple[np.ndarray, ...] | None = None  # of the next longer order: grams, counts, context of each gram, and by code: distinct symbols

    def step(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, gone: np.ndarray, gone_kinds: np.ndarray) -> None:
        left, new = total - gone, kinds - gone_kinds
        use = open_ & (left > 0)
        hit = use & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[use] += np.log10(np.where(hit, 2 * count - 1, new)[use] / (2 * left)[use])
        open_[hit] = False

    table = pairs.reshape(1 << BITS, 1 << BITS).astype(np.float64)
    zero = table.sum(axis=0)
    for j in range(order, -1, -1):
        gram = code & _mask(j + 1)
        if j >= 2:
            u, at = np.unique(gram, return_inverse=True)
            c = np.bincount(at, n, len(u))
            if j == 2 and hot is not None and len(hot):
                u, at, c = _with_hot(u, at, c, hot, follow)
            ctx, of = np.unique(u >> BITS, return_inverse=True)
            total, kinds = np.bincount(of, c, len(ctx)), np.bincount(of, c > 0, len(ctx))
            mine, total, kinds = c[at], total[of][at], kinds[of][at]
            lower = lambda g, u=u, c=c: c[np.searchsorted(u, g)]
        elif j == 1:
            by, s = gram >> BITS, gram & _mask(1)
            mine, total, kinds = table[by, s], table.sum(axis=1)[by], (table > 0).sum(axis=1)[by]
            u, c, of, at = None, None, None, None
            lower = lambda g: pairs[g].astype(np.float64)
        else:
            s = gram
            mine, total, kinds = zero[s], np.full(len(code), zero.sum()), np.full(len(code), (zero > 0).sum())
        if above is None:
            gone = gone_kinds = np.zeros(len(code))
        else:
            ug, uc, uof, uat, ukinds = above
            gone_kinds = ukinds
            if ug is not None:
                held = np.bincount(uof, np.where(uc > 0, (zero[ug & _mask(1)] if j == 0 else lower(ug & _mask(j + 1))), 0))
                gone = held[uof][uat]
            else:  # above is order 1, from the table
                gone = ((table > 0) @ zero)[(code & _mask(2)) >> BITS]
        step(mine, total, kinds, gone, gone_kinds)
        above = (u, c, of, at, kinds) if j else None
    out[open_] -= np.log10(SYMBOLS - (zero > 0).sum())
    return out


def _with_hot(u: np.ndarray, at: np.ndarray, c: np.ndarray, hot: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of order 2 with the counts of hot pairs from their table, and all that is known to follow these."""
    place = np.minimum(np.searchsorted(hot, u >> BITS), len(hot) - 1)
    mine = np.unique(place[hot[place] == u >> BITS])
    of, symbol = np.nonzero(follow[mine])
    whole = np.union1d(u, hot[mine][of] << BITS | symbol)
    counts = np.zeros(len(whole))
    counts[np.searchsorted(whole, u)] = c
    place = np.minimum(np.searchsorted(hot, whole >> BITS), len(hot) - 1)
    is_hot = hot[place] == whole >> BITS
    counts[is_hot] = follow[place[is_hot], whole[is_hot] & _mask(1)]
    return whole, np.searchsorted(whole, u)[at], counts


def scores(docs: DataFrame, held_out: Column, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows where held_out is true aren't learnt from.

    order: from 3 to 6 bytes of context.
    """
    spark = docs.sparkSession
    blocks, number = blocks_of(docs, key, text, held_out)
    shards = max(16, 4 * number)
    sent_tables = spark.sparkContext.broadcast(short_contexts(blocks))  # at most (257 + HOT) * 512 numbers
    kind = docs.schema[key].dataType.simpleString()

    def shard_of(what: int, keys: np.ndarray) -> np.ndarray:
        if what == GRAM:
            two = (keys >> BITS) & _mask(2)
            hot = np.zeros(1 << 2 * BITS, bool)
            hot[sent_tables.value[1]] = True
            keys = np.where(hot[two], (keys >> BITS) & _mask(3), two | 1 << 3 * BITS)
        return (mixed(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number_, body in zip(batch.column(0), batch.column(1)):
                sums = {GRAM: Sums(), TOKEN: Sums()}
                for rows in opened([body]):
                    for held in (False, True):
                        data, offsets = utf8(rows.filter(rows["held"] if held else pc.invert(rows["held"]))["text"])
                        for what, found in ((GRAM, _codes(*_symbols(data, offsets), order)), (TOKEN, _words(data, offsets))):
                            for keys, _, _ in found:
                                k, c = np.unique(keys, return_counts=True)
                                sums[what].add(k, np.zeros(len(k), np.int64) if held else c)
                for what in (GRAM, TOKEN):
                    k, c = sums.pop(what).done()
                    to = shard_of(what, k)
                    order_ = np.argsort(to, kind="stable")
                    k, c, to = k[order_], c[order_].astype(np.uint32), to[order_]
                    edges = np.searchsorted(to, np.arange(shards + 1))
                    some = np.flatnonzero(np.diff(edges))
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([what] * n, pa.int32()), pa.array([number_.as_py()] * n, pa.int64())]
                        + [pa.array([squeezed(k[edges[i] : edges[i + 1]], True) for i in some], pa.binary()), pa.array([squeezed(c[edges[i] : edges[i + 1]]) for i in some], pa.binary())],
                        names=["shard", "what", "block", "keys", "counts"],
                    )

    sent = blocks.mapInArrow(emit, "shard int, what int, block long, keys binary, counts binary")

    def model(group: tuple, table: pa.Table) -> pa.Table:
        what = group[1].as_py()
        sums = Sums()
        for keys, counts in zip(table["keys"], table["counts"]):
            sums.add(unsqueezed(keys.as_buffer(), np.int64, True), unsqueezed(counts.as_buffer(), np.uint32).astype(np.int64))
        k, c = sums.done()
        pairs, hot, follow = sent_tables.value
        value = log_probabilities(k, c, pairs, order, hot, follow) if what == GRAM else c.astype(np.float64)
        n = table.num_rows
        total = [0, 0] if what == GRAM else [int(c.sum()), int((c > 0).sum())]
        return pa.table(
            {
                "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
                "what": pa.array([what] * n + [STATS], pa.int32()),
                "keys": pa.array([*[x.as_py() for x in table["keys"]], None], pa.binary()),
                "found": pa.array([*[squeezed(value[np.searchsorted(k, unsqueezed(x.as_buffer(), np.int64, True))]) for x in table["keys"]], None], pa.binary()),
                "n": pa.array([None] * n + [total[0]], pa.int64()),
                "v": pa.array([None] * n + [total[1]], pa.int64()),
            }
        )

    answers = stored(sent.groupBy("shard", "what").applyInArrow(model, "block long, what int, keys binary, found binary, n long, v long"))
    stats = answers.filter(F.col("what") == STATS).agg(F.sum("n"), F.sum("v")).first()
    n_train, n_words = int(stats[0] or 0), int(stats[1] or 0)
    scale = math.log10(n_train + 0.5 * (n_words + 1))

    def score(group: tuple, texts: pa.Table, values: pa.Table) -> pa.Table:
        import pandas as pd

        index, found = {}, {}
        for what in (GRAM, TOKEN):
            mine = values.filter(pc.equal(values["what"], what))
            index[what] = pd.Index(np.concatenate([np.zeros(0, np.int64), *[unsqueezed(x.as_buffer(), np.int64, True) for x in mine["keys"]]]))
            found[what] = np.concatenate([np.zeros(0), *[unsqueezed(x.as_buffer(), np.float64) for x in mine["found"]]])
        out: list[list] = [[], [], [], [], [], []]
        for batch in opened(texts["body"]):
            data, offsets = utf8(batch["text"])
            rows = batch.num_rows
            n, known, base, logs = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            for code, r, size in _codes(*_symbols(data, offsets), order):
                logs[r : r + len(size)] += _row_sums(found[GRAM][index[GRAM].get_indexer(code)], size)
            for word, r, size in _words(data, offsets):
                c = found[TOKEN][index[TOKEN].get_indexer(word)]
                n[r : r + len(size)] += size
                known[r : r + len(size)] += _row_sums((c > 0).astype(np.int64), size)
                base[r : r + len(size)] += _row_sums(np.log10(c + 0.5), size)
            for x, v in zip(out, (batch["key"], batch["held"], pa.array(n), pa.array(known), pa.array(base - n * scale), pa.array(logs))):
                x.append(v)
        names = [key, "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table({name: pa.chunked_array(x) for name, x in zip(names, out)})

    values = answers.filter(F.col("what") != STATS).select("block", "what", "keys", "found")
    out = blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long")).select(key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
