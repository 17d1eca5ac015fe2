"""Quality by the perplexity of an interpolated modified Kneser-Ney model (words, order 3).

The model is trained on all trusted texts but those that thresholds come from.  Only counts are kept: a shard
has whole sorted tables of trigrams, coded by their steps, and works out continuation counts and shares as it
answers.  A block of documents sends its distinct trigrams, bigrams of hubs and words to the shards, gets shares
and probabilities back in the same order, and adds them up by document.  Texts are counted, and scored, in slices, and
what a slice shuffled and stored goes before the next, so disk holds the counts and the messages of one slice.
Sent to all are the hubs (fewer than HUBS words, with two numbers each) and a few numbers.

Words are 64-bit hashes, so their number has no bound.  Blocks and shards number theirs in the order of the hashes, so that
questions come in the order of the tables they are looked for in.
`Model` may also be fitted on a bounded sample: texts in the order of their hashes, as long as all
their words are at most MOST.

A document is kept if its perplexity is at most a quantile of the perplexities of trusted
texts of its language that the model hasn't seen.

Defined cases: a null or empty text is scored for its end alone; where a language has no
trusted texts (or the language is null) the quantile over all trusted texts stands in, and
without any trusted text all documents are kept; a document with several labels is trusted
if all of them are good; repeated rows are scored one by one; a long text is scored whole, and is a
block of its own; null ids are never trusted; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import opened, packed, squeezed, unsqueezed
from .tables import bucketed, chunks, forget, mixed, stored, stored_once, utf8, words_of

#: Of the trusted documents, one in so many is never trained on, so that thresholds come from texts that are new to the model.
HELD_OUT = 5
START, STOP = 1, 2  # stand among the hashes of words
FIRST = 4  # the first number of a word in a bounded model's arrays
#: Bound of a bounded sample in distinct words.
MOST = (1 << 21) - FIRST
#: A word outside the vocabulary is one of so many: else text of unknown words alone would look likely.
OTHER_WORDS = 100_000
QUANTILE, SLACK = 0.99, 1.25
#: Bytes of text that are hashed at once, few enough for a processor's cache (one document at least).
HASHED = 1 << 18
#: Bytes of text in a block, about twice the bytes that are stored.
TEXTS = 32 << 20
#: Of this prime's remainders the shards are made; trigrams of the model in a shard, roughly, the shards (so the messages of a
#: block are bounded), and blocks that one copy of a model of FEW shards answers; one of more shards answers more.
PRIME, ROWS, SHARDS, FEW, ANSWERED = 1_000_003, 1 << 20, 4096, 8, 64
#: Slices of the texts that are scored, or counted, one after the other, and bytes of text that one has at least.
SLICES, TAUGHT, SLICE = 8, 4, 1 << 23
#: The counts of so many halves, thirds, ... of the shards are shuffled one after the other, since this is what fills disks most.
GOES = 2
#: Buckets for each shard of the model's table, so that few hold two shards.
DEALT = 4
#: Blocks of a slice, at least: few, since a word is sent once for each block and shard.
BLOCKS = 12
#: Tokens whose trigrams are counted together, and the share of trigrams beyond which a middle word is a hub, one in so many.
GATHERED, HUBS = 1 << 22, 256


def encoded(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of some rows, with the end after each row's, and how many each row has."""
    for a, b in chunks(offsets, HASHED):
        words, _, _, before = words_of(data, offsets[a : b + 1], lower=True)
        yield np.insert(words.view(np.int64), before[1:], STOP), np.diff(before) + 1


def grams(w: np.ndarray, size: np.ndarray, start: int = START) -> tuple[np.ndarray, np.ndarray]:
    """The second and the first word before each token of texts of these sizes."""
    first = np.cumsum(size) - size
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[first] = u[first] = u[(first + 1)[size > 1]] = start
    return u, v


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(*columns: np.ndarray) -> np.ndarray:
    """F.xxhash64 of columns of longs."""
    h = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        z = x.view(np.uint64) * _P2
        h = (h + (_P5 + np.uint64(8))) ^ (z << np.uint64(31) | z >> np.uint64(33)) * _P1
        h = (h << np.uint64(27) | h >> np.uint64(37)) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def within(texts: DataFrame) -> DataFrame:
    """The texts in the order of their hashes, as long as all their words are at most MOST."""

    def first_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            draw = batch.column(1).to_numpy()
            for a, b in chunks(offsets):
                words, _, _, before = words_of(data, offsets[a : b + 1], lower=True)
                k, at = np.unique(words, return_inverse=True)
                first = np.full(len(k), np.iinfo(np.int64).max)
                np.minimum.at(first, at, np.repeat(draw[a:b], np.diff(before)))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(first)], names=["w", "draw"])

    texts = stored(texts.withColumn("draw", F.xxhash64("text")))
    new = texts.mapInArrow(first_draws, "w long, draw long").groupBy("w").agg(F.min("draw").alias("draw")).groupBy("draw").count()
    new = new.toArrow().sort_by("draw")  # a row for a text of the sample at most
    over = np.flatnonzero(np.cumsum(new["count"].to_numpy()) > MOST)
    return texts.filter(F.col("draw") < int(new["draw"][int(over[0])].as_py())) if len(over) else texts


def vocabulary(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of tokens, as they come up, and which of them each is."""
    out = pa.array(tokens).dictionary_encode()
    return out.dictionary.to_numpy(), out.indices.to_numpy()


#: Words of some texts, which of them each token is, and how many tokens each text has.
Texts = tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct(texts: list[Texts], back: bool = False) -> tuple[np.ndarray, ...]:
    """The words of the texts, sorted, and their distinct trigrams, as places in these, sorted by v, u and w: words, v, u, w, n, and (if asked for) which of them each token ends."""
    words, at = np.unique(np.concatenate([*(t[0] for t in texts), np.array([START], np.int64)]), return_inverse=True)
    places = np.split(at[:-1], np.cumsum([len(t[0]) for t in texts])[:-1])
    w = np.concatenate([p[t[1]] for p, t in zip(places, texts)])
    u, v = grams(w, np.concatenate([t[2] for t in texts]), at[-1])
    return words, *summed(len(words), v, u, w, back=back)


def steps(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def summed(kinds: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray | None = None, back: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct rows of numbers less than kinds, sorted by v, u and w, with the sums of n (or how many they are), and (if asked for) which of them each row is."""
    order = None
    if kinds <= 1 << 21:
        key = v << 42 | u << 21 | w
        if n is None and not back:
            key.sort()
        else:
            order = np.argsort(key)  # not the stable way, which is slower: equal rows are one
            key = key[order]
        new = steps(key)
        key = key[new]
        v, u, w = key >> 42, key >> 21 & (1 << 21) - 1, key & (1 << 21) - 1
    else:
        order = np.lexsort((w, u, v))
        v, u, w = v[order], u[order], w[order]
        new = steps(v, u, w)
        v, u, w = v[new], u[new], w[new]
    first = np.flatnonzero(new)
    if n is None:
        n = np.diff(np.append(first, len(new)))
    else:
        n = np.add.reduceat(n[order], first) if len(first) else n
    if not back:
        return v, u, w, n
    which = np.empty(len(new), np.int64)
    which[order] = np.cumsum(new) - 1
    return v, u, w, n, which


_PARTS = struct.Struct("<5Q")


def coded(words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Rows sorted by v, u and w (places in sorted words), v and u by their steps, with the words they have."""
    used = np.zeros(len(words), bool)
    for x in (v, u, w):
        used[x] = True
    used = np.flatnonzero(used)
    place = np.empty(len(words), np.int64)
    place[used] = np.arange(len(used))
    v, u, w = place[v], place[u], place[w]
    numbers = np.diff(v, prepend=0), np.where(steps(v), u, np.diff(u, prepend=0)), w, n
    bodies = [squeezed(words[used], True), *(squeezed(x.astype(np.uint32)) for x in numbers)]
    return b"".join([_PARTS.pack(*map(len, bodies)), *bodies])


def decoded(body: pa.Buffer) -> tuple[np.ndarray, ...]:
    """words, v, u, w, n of what was coded."""
    body = memoryview(body)
    ends = np.cumsum([_PARTS.size, *_PARTS.unpack(body[: _PARTS.size])])
    words = unsqueezed(body[ends[0] : ends[1]], np.int64, True)
    v, u, w, n = (unsqueezed(body[a:b], np.uint32) for a, b in zip(ends[1:-1], ends[2:]))
    new = v != 0
    new[:1] = True
    first = np.flatnonzero(new)
    sums = np.cumsum(u, dtype=np.int64)
    sums -= np.repeat(sums[first] - u[first], np.diff(np.append(first, len(u))))
    return words, np.cumsum(v, dtype=np.int64), sums, w.astype(np.int64), n.astype(np.int64)


def together(bodies: pa.ChunkedArray, pairs: bool = False) -> tuple[np.ndarray, ...]:
    """The sums of several coded tables, of pairs v and w or of all three: words, v, u, w, n."""
    tables = [decoded(x.as_buffer()) for x in bodies]
    words, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    places = np.split(at, np.cumsum([len(t[0]) for t in tables])[:-1])
    v, u, w = (np.concatenate([p[t[i]] for p, t in zip(places, tables)]) for i in (1, 2, 3))
    u = u * 0 if pairs else u
    return words, *summed(len(words), v, u, w, np.concatenate([t[4] for t in tables]))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % PRIME % shards).astype(np.int64)


def grouped(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in `to` (of shards) and where it is, in order."""
    order = np.argsort(to.astype(np.uint16), kind="stable")  # by digits, as no more than 16 bits are given
    first = np.flatnonzero(steps(to[order]))
    for a, b in zip(first, np.append(first[1:], len(to))):
        yield int(to[order[a]]), order[a:b]


def dealt(words: np.ndarray, v: np.ndarray, u: np.ndarray, hubs: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of trigrams, and which go there, in order."""
    to = shard_of(hashed(words), shards)[v]
    hub = np.flatnonzero(np.isin(words, hubs)[v])
    to[hub] = shard_of(hashed(words[u[hub]], words[v[hub]]), shards)
    return grouped(to)


class Questions:
    """What a block of texts asks: its distinct trigrams, its bigrams of hubs and its words, each of one shard."""

    def __init__(self, texts: list[Texts], hubs: np.ndarray, shards: int, back: bool = False):
        self.words, self.v, self.u, self.w, _, *self.back = distinct(texts, back)
        words, v, w = self.words, self.v, self.w
        self.hub = np.flatnonzero(np.isin(words, hubs)[v])
        none = np.zeros(len(self.hub), np.int64)
        self.bv, _, self.bw, _, self.pair = summed(len(words), v[self.hub], none, w[self.hub], back=True)
        self.of = {(3, s): at for s, at in dealt(words, v, self.u, hubs, shards)}
        self.of |= {(2, s): at for s, at in grouped(shard_of(hashed(words[self.bv], words[self.bw]), shards))}
        self.of |= {(1, s): at for s, at in grouped(shard_of(hashed(words), shards))}

    def bodies(self) -> Iterator[bytes]:
        for (kind, _), at in self.of.items():
            none = np.zeros(len(at), np.int64)
            if kind == 3:
                yield coded(self.words, self.v[at], self.u[at], self.w[at], none)
            elif kind == 2:
                yield coded(self.words, self.bv[at], none, self.bw[at], none)
            else:
                yield squeezed(self.words[at], True)


#: kind: 3 trigrams, 2 bigrams of hubs, 1 words (and their counts, in stats), 0 numbers only.
KINDS = "shard int, kind int, body binary, stats array<long>"


def kinds_table(rows: list[tuple[int, int, bytes, list[int]]]) -> pa.Table:
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())
    return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("shard", "kind", "body", "stats"))})


def word_rows(words: np.ndarray, n: np.ndarray, shards: int) -> list[tuple[int, int, bytes, list[int]]]:
    return [(s, 1, squeezed(words[at], True), n[at].tolist()) for s, at in grouped(shard_of(hashed(words), shards))]


def spectrum(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


class Model:
    """Counts of trigrams, of the bigrams of hubs and of words, in shards; whole: of all texts given, else of those `within` MOST words.

    A trigram is in the shard of its middle word, where all counts that its probability needs are, but for its
    last word's own.  A middle word that more than one in HUBS trigrams has is a hub: its trigrams are dealt by their first
    two words, and its bigrams by both of theirs.
    """

    def __init__(self, trusted: DataFrame | list[DataFrame], text: str = "text", whole: bool = False):
        """trusted: texts, or slices of them, that are counted one after the other."""
        slices = [x.select(F.coalesce(text, F.lit("")).alias("text")) for x in (trusted if isinstance(trusted, list) else [trusted])]
        slices = slices if whole else [within(x) for x in slices]

        def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts: list[Texts] = []

            def counted() -> pa.RecordBatch:
                words, v, u, w, n = distinct(texts)
                texts.clear()
                middle = np.bincount(v, n, len(words)).astype(np.int64)
                top = np.flatnonzero(middle * HUBS > middle.sum())  # a hub of all texts is one of some part of them
                tops = squeezed(words[top]), squeezed(middle[top])
                return pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(v)]), *(pa.array([x], pa.binary()) for x in (*tops, coded(words, v, u, w, n)))], names=["all", "kinds", "top", "of", "body"])

            held = 0
            for batch in batches:
                for tokens, size in encoded(*utf8(batch.column(0))):
                    texts.append((*vocabulary(tokens), size))
                    held += len(tokens)
                    if held >= GATHERED:
                        yield counted()
                        held = 0
            if texts:
                yield counted()

        parts = [stored_once(x.mapInArrow(count_grams, "all long, kinds long, top binary, of binary, body binary")) for x in slices]
        chunks_ = parts[0]
        for x in parts[1:]:
            chunks_ = chunks_.union(x)
        tokens, kinds = chunks_.agg(F.sum("all"), F.sum("kinds")).first()
        self.shards = shards = min(SHARDS, max(FEW, (kinds or 0) // ROWS))

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for top, of in zip(batch.column(0), batch.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(top.as_buffer(), np.int64)), pa.array(unsqueezed(of.as_buffer(), np.int64))], names=["v", "n"])

        often = chunks_.select("top", "of").mapInArrow(tops, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
        self.hubs = hubs = np.array(sorted(r[0] for r in often.filter(F.col("n") * HUBS > (tokens or 0)).collect()), np.int64)  # fewer than HUBS

        def dealing(go: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for body in batch.column(0):
                        words, v, u, w, n = decoded(body.as_buffer())
                        rows = [(s, coded(words, v[at], u[at], w[at], n[at])) for s, at in dealt(words, v, u, hubs, shards) if s % GOES == go]
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "body"])

            return deal

        def merge(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            words, v, u, w, n = together(table["body"])
            rows = [(shard, 3, coded(words, v, u, w, n), spectrum(n))]
            # Continuation counts; what follows the start has no word before it, so its own count stands.
            pair, back = np.unique(v * np.int64(len(words)) + w, return_inverse=True)
            bv, bw = pair // max(len(words), 1), pair % max(len(words), 1)
            bn = np.where(words[bv] == START, np.bincount(back, n, len(pair)), np.bincount(back, minlength=len(pair))).astype(np.int64)
            own = ~np.isin(words, hubs)[bv]
            rows.append((shard, 0, b"", spectrum(bn[own])))
            kinds = np.bincount(bw[own], minlength=len(words))
            some = np.flatnonzero(kinds)
            rows += word_rows(words[some], kinds[some], shards)
            hub = np.flatnonzero(~own)
            to = shard_of(hashed(words[bv[hub]], words[bw[hub]]), shards)
            for s, at in grouped(to):
                rows.append((s, 2, coded(words, bv[hub][at], np.zeros(len(at), np.int64), bw[hub][at], bn[hub][at]), []))
            return kinds_table(rows)

        def merge_hubs(table: pa.Table) -> pa.Table:
            words, v, _, w, n = together(table["body"], True)
            rows = [(table["shard"][0].as_py(), 2, coded(words, v, np.zeros(len(v), np.int64), w, n), spectrum(n))]
            for i in np.unique(v):
                some = n[v == i]
                rows.append((0, 0, words[i : i + 1].tobytes(), [int(x) for x in (some.sum(), (some == 1).sum(), (some == 2).sum(), (some > 2).sum())]))
            kinds = np.bincount(w, minlength=len(words))
            some = np.flatnonzero(kinds)
            return kinds_table(rows + word_rows(words[some], kinds[some], shards))

        def merge_words(table: pa.Table) -> pa.Table:
            words = np.concatenate([unsqueezed(x.as_buffer(), np.int64, True) for x in table["body"]])
            n = np.concatenate([np.array(x.as_py(), np.int64) for x in table["stats"]])
            words, at = np.unique(words, return_inverse=True)
            n = np.bincount(at, n, len(words)).astype(np.int64)
            return kinds_table([(table["shard"][0].as_py(), 1, squeezed(words, True), n.tolist())])

        goes = [chunks_.select("body").mapInArrow(dealing(go), "shard int, body binary") for go in range(GOES)]
        merged = [stored_once(go.groupBy("shard").applyInArrow(merge, KINDS), "kind") for go in goes]
        three = merged[0]
        for x in merged[1:]:
            three = three.unionByName(x)
        for x in parts:
            forget(x)
        two = stored_once(three.filter("kind = 2").select("shard", "body").groupBy("shard").applyInArrow(merge_hubs, KINDS), "kind")
        one = three.unionByName(two).filter("kind = 1")
        one = stored_once(one.select("shard", "body", "stats").groupBy("shard").applyInArrow(merge_words, KINDS))
        self.parts = [one]
        self.table, self.name = bucketed(three.filter("kind = 3").unionByName(two.filter("kind = 2")).unionByName(one), "shard", DEALT * shards)

        def discounts(*counts: DataFrame) -> tuple[float, float, float]:
            n = np.zeros(4)
            for x in counts:
                n += [float(y or 0) for y in x.agg(*[F.sum(F.col("stats")[i]) for i in range(4)]).first()]
            n1, n2, n3, n4 = n.tolist()
            if not n1 or not n2:
                return 0.5, 0.75, 0.9
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            return tuple(min(max(x, 0.05), cap) for x, cap in zip(d, (0.95, 1.95, 2.95)))

        numbers = [F.size("stats") - F.size(F.array_remove("stats", i)) for i in range(1, 5)]
        of_words = one.select(F.array(*numbers).alias("stats"), F.size("stats").alias("kinds"), F.aggregate("stats", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
        d3, d2, d1 = discounts(three.filter("kind = 3")), discounts(three.filter("kind = 0"), two.filter("kind = 2")), discounts(of_words)
        kinds, total, n1, n2 = (x or 0 for x in of_words.agg(F.sum("kinds"), F.sum("all"), F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first())
        cut = n1 * d1[0] + n2 * d1[1] + (kinds - n1 - n2) * d1[2]
        # What any word gets: a share of what is discounted.  Besides the words there are the end, the start and the unknown word.
        self.base = (cut / total if total else 1.0) / (max(kinds, 1) + 2)
        self.total, self.discounts = total, (d1, d2, d3)
        # All and cut of each hub.
        sums = two.filter("kind = 0").groupBy("body").agg(*[F.sum(F.col("stats")[i]) for i in range(4)]).collect()
        self.after = {int(np.frombuffer(r[0], np.int64)[0]): (float(r[1]), float(np.dot(r[2:], d2))) for r in sums}

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body, n in zip(batch.column(0), batch.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(body.as_buffer(), np.int64, True)), n.values], names=["w", "n"])

        forget(three)
        forget(two)
        self.one = one.select("body", "stats").mapInArrow(listed, "w long, n long")

    def forget(self) -> None:
        for x in (*self.parts, self.table):
            forget(x)
        self.table.sparkSession.sql(f"drop table {self.name}")

    def _numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a bounded model, at most MOST words: their hashes, sorted, their numbers, frequent ones first, and the probability of each number."""
        table = self.one.toArrow()
        words, n = table["w"].to_numpy().view(np.uint64), table["n"].to_numpy()
        number = np.full(len(words), 3)
        some = words != STOP
        number[np.flatnonzero(some)[np.lexsort((words[some], -n[some]))]] = FIRST + np.arange(some.sum())
        p = np.full(FIRST + some.sum(), self.base)
        p[0] = 0
        d = np.array(self.discounts[0])[np.minimum(n, 3) - 1]
        p[number] += np.maximum(n - d, 0) / max(n.sum(), 1)
        order = np.flatnonzero(some)[np.argsort(words[some])]
        return words[order], number[order], p

    @property
    def vocabulary(self) -> np.ndarray:
        return self._numbered()[0]

    @property
    def of(self) -> np.ndarray:
        return self._numbered()[1]

    @property
    def unigrams(self) -> np.ndarray:
        return self._numbered()[2]


def perplexities(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry along, n_tokens (words and the end), log10_probability and perplexity of every row."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices = sliced(docs, size, SLICES, key, text)
    parts = [_scored(x, size // len(slices), model, key, text, carry) for x in slices]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_probability") / F.col("n_tokens")))


def sliced(docs: DataFrame, size: int, most: int, *by: str) -> list[DataFrame]:
    """docs, of size bytes of text, in `most` slices (fewer if these would be small), so that disk holds what is sent for one slice only."""
    n = min(most, max(1, size // SLICE))
    return [docs.filter(F.pmod(F.xxhash64(*by, F.lit(n)), F.lit(n)) == i) for i in range(n)] if n > 1 else [docs]


def _scored(docs: DataFrame, size: int, model: Model, key: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    number = max(1, -(-size // TEXTS))
    shards, hubs, after, base, total, (d1, d2, d3) = model.shards, model.hubs, model.after, model.base, model.total, model.discounts
    copies = -(-number * FEW // (ANSWERED * shards))
    kept = [key, *carry]
    kinds = [docs.schema[c].dataType.simpleString() for c in kept]

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, size = (np.concatenate(x) for x in zip(*encoded(*utf8(batch.column(len(kept))))))
        words, local = vocabulary(tokens)  # the batch's own, and places in it
        ends = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
        planes = [pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, ends, pa.py_buffer((local >> shift).astype(np.uint8))]) for shift in (0, 8, 16, 24)]  # the high bytes compress well
        known = pa.array([words.tobytes(), *[b""] * (batch.num_rows - 1)], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *planes, known], names=[*map(str, range(len(kept))), "b0", "b1", "b2", "b3", "words"])

    # About half of the words' bytes are stored.
    blocks = packed(docs.select(*kept, F.coalesce(F.col(text), F.lit(""))), convert, -(-size // 2), -(-TEXTS // 2), BLOCKS)

    def texts_of(batch: pa.RecordBatch) -> Texts:
        planes = [np.frombuffer(batch[f"b{i}"].buffers()[2], np.uint8).astype(np.uint32) << np.uint32(8 * i) for i in range(4)]
        ends = np.frombuffer(batch["b0"].buffers()[1], np.int32)[: batch.num_rows + 1]
        return np.frombuffer(batch["words"][0].as_buffer(), np.int64), (planes[0] | planes[1] | planes[2] | planes[3])[: ends[-1]], np.diff(ends)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0), batch.column(1)):
                asked = Questions([texts_of(part) for part in opened([body])], hubs, shards)
                copy = int(mixed(np.array([block.as_py()], np.uint64))[0] % np.uint64(copies))
                kinds = [k for k, _ in asked.of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s + shards * copy for _, s in asked.of], pa.int32()), pa.array([block.as_py()] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(list(asked.bodies()), pa.binary())],
                    names=["shard", "block", "kind", "body"],
                )

    asked = blocks.mapInArrow(ask, "shard int, block long, kind int, body binary")

    def discounted(n: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
        cut = np.array([0.0, *d])[np.minimum(n, 3)]
        return np.maximum(n - cut, 0.0), cut

    def shares(n: np.ndarray, d: tuple[float, float, float], first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each gram has of its own, and of each context (its grams begin at first) the share of the shorter one; last, what unseen ones have."""
        own, cut = discounted(n, d)
        alls, cuts = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n, cut))
        return np.append(own / alls[of], 0.0), np.append(cuts / alls, 1.0)

    def answer(questions: pa.Table, rows: pa.Table) -> pa.Table:
        """For each question x and y: of a word its probability, of others what is theirs, and the share of the shorter context."""
        held = {k.as_py(): (b, s) for k, b, s in zip(rows["kind"], rows["body"], rows["stats"])}
        nothing = np.zeros(0, np.int64)
        words, v, u, w, n = decoded(held[3][0].as_buffer()) if 3 in held else (nothing,) * 5
        # All tables are sorted by places in words, which two words' bits keep apart; words are sorted too, as those of questions
        # are, so that what is looked for one after the other is near.
        new = steps(v, u)
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        contexts, threes = v[first] << 31 | u[first], of << 31 | w
        share_c, rest_c = shares(n, d3, first, of)
        own = ~np.isin(words, hubs)[v]
        twos = np.sort(v[own] << 31 | w[own])
        at = np.flatnonzero(steps(twos))
        bn = np.diff(np.append(at, len(twos)))
        twos = twos[at]
        begins = words[twos >> 31] == START
        bn[begins] = n[np.flatnonzero(own & (words == START)[v])]
        new = steps(twos >> 31)
        first = np.flatnonzero(new)
        middles = twos[first] >> 31
        share_v, rest_v = shares(bn, d2, first, np.cumsum(new) - 1)
        hw, hv, _, hx, hn = decoded(held[2][0].as_buffer()) if 2 in held else (nothing,) * 5
        hub_twos, hub_own = hv << 31 | hx, np.append(discounted(hn, d2)[0], 0.0)
        known = unsqueezed(held[1][0].as_buffer(), np.int64, True) if 1 in held else nothing
        one, _ = discounted(np.array(held[1][1].as_py() if 1 in held else [], np.int64), d1)

        out: dict[str, list] = {"block": [], "shard": [], "kind": [], "x": [], "y": []}
        for block, shard, kind, body in zip(*(questions[c] for c in ("block", "shard", "kind", "body"))):
            if kind.as_py() == 1:
                at = place(known, unsqueezed(body.as_buffer(), np.int64, True))
                x, y = np.where(at < 0, np.nan, np.append(one, 0.0)[at] / (total or 1) + base), np.zeros(0)
            else:
                qw, qv, qu, qx, _ = decoded(body.as_buffer())
                if kind.as_py() == 2:
                    some, back = np.unique(qv, return_inverse=True)
                    alls, cuts = (np.array([after.get(int(i), (1.0, 1.0))[k] for i in qw[some]])[back] for k in (0, 1))
                    places = place(hw, qw)
                    x, y = hub_own[among(hub_twos, places[qv], places[qx])] / alls, cuts / alls
                else:
                    places = place(words, qw)  # -1 makes a key that no table has
                    c = places[qx]
                    new_v, new_u = steps(qv), steps(qv, qu)  # each context is looked up once
                    first = np.flatnonzero(new_u)
                    context = place(contexts, places[qv[first]] << 31 | places[qu[first]])[np.cumsum(new_u) - 1]
                    middle = place(middles, places[qv[np.flatnonzero(new_v)]])[np.cumsum(new_v) - 1]
                    x3, x2 = (share[among(table, i, c)] for share, table, i in ((share_c, threes, context), (share_v, twos, np.append(middles, -1)[middle])))
                    y3 = rest_c[context]
                    x, y = x3 + y3 * x2, y3 * rest_v[middle]  # a hub's own bigrams aren't in this table: it adds nothing
            for name, value in (("block", block.as_py()), ("shard", shard.as_py() % shards), ("kind", kind.as_py()), ("x", squeezed(x.astype(np.float32))), ("y", squeezed(y.astype(np.float32)) if len(y) else b"")):
                out[name].append(value)
        return pa.table({"block": pa.array(out["block"], pa.int64()), **{c: pa.array(out[c], pa.int32()) for c in ("shard", "kind")}, **{c: pa.array(out[c], pa.binary()) for c in ("x", "y")}})

    rows = model.table
    if copies > 1:
        rows = rows.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: (F.col("shard") + shards * c).cast("int"))))
    answers = asked.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(answer, "block long, shard int, kind int, x binary, y binary")

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        parts = list(opened(texts["body"]))
        rows = [texts_of(part) for part in parts]
        q = Questions(rows, hubs, shards, back=True)
        found = {k: np.full((2, n), np.nan) for k, n in ((1, len(q.words)), (2, len(q.bv)), (3, len(q.v)))}
        for kind, shard, x, y in zip(*(values[c] for c in ("kind", "shard", "x", "y"))):
            at = q.of[kind.as_py(), shard.as_py()]
            for of, z in zip(found[kind.as_py()], (x, y)):
                if z.as_buffer().size:
                    of[at] = unsqueezed(z.as_buffer(), np.float32)
        one = found[1][0]
        unknown = np.isnan(one)
        short = np.where(unknown, base, one)[q.w]
        x, y = found[2][:, q.pair]
        short[q.hub] = x + y * short[q.hub]
        logs = np.log10(found[3][0] + found[3][1] * short) - np.where((unknown & (q.words != STOP))[q.w], np.log10(OTHER_WORDS), 0.0)
        size = np.concatenate([r[2] for r in rows]).astype(np.int64)
        total = np.bincount(np.repeat(np.arange(len(size)), size), logs[q.back[0]], len(size))
        columns = [pa.chunked_array([part.column(i) for part in parts]) for i in range(len(kept))]
        return pa.table({str(i): x for i, x in enumerate([*columns, pa.array(size), pa.array(total)])})

    names = [*(f"`{i}` {kind}" for i, kind in enumerate(kinds)), f"`{len(kept)}` long", f"`{len(kept) + 1}` double"]
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ", ".join(names)).toDF(*kept, "n_tokens", "log10_probability")
    out = stored_once(out)
    forget(blocks)
    return out


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys are in a sorted table of distinct ones, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def among(table: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where grams of a context and a word are in a table, or -1; only those of known contexts and words are looked for."""
    at = np.full(len(word), -1)
    some = np.flatnonzero((context >= 0) & (word >= 0))
    at[some] = place(table, context[some] << 31 | word[some])
    return at


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_tokens, log10_probability, perplexity, threshold and kept for docs (doc_id, text, lang); labels: doc_id, quality."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    taught = good.filter(part != 0)
    slices = sliced(docs, size, TAUGHT, "doc_id")
    # Few large parts: a word is sent once for each of them and each shard.
    tasks = max(BLOCKS, -(-size // (len(slices) * TEXTS)))
    model = Model([x.join(taught, "doc_id", "left_semi").coalesce(tasks) for x in slices], whole=True)
    scored = perplexities(docs, model, carry=("lang",))
    model.forget()
    seen = scored.join(good.filter(part == 0), "doc_id", "left_semi")
    limits = seen.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10000) * slack).alias("threshold"))
    overall = seen.agg((F.percentile_approx("perplexity", quantile, 10000) * slack).alias("t")).first()[0]
    out = scored.join(limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "n_tokens", "log10_probability", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels)
