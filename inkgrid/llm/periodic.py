"""Periodic runs of words in each document, found on a grammar of the repetitive stretches.

A run is a stretch of consecutive words in which words q apart are identical, with q the smallest
such period, that is at least two periods (and min_words) long and that neither neighbour extends.

1. Stretches.  In a run of period q and length n, n - q consecutive words stand again q words on,
   and n - q is at least half of min_words.  So every word of a run is in a window of that many
   words that the document has twice; only stretches of such words go on, and the test is made again
   within each of them until none gets shorter.
2. Grammar.  Re-Pair replaces the pairs of neighbours that are most frequent by a new symbol, all
   through the stretches of a chunk.  Pairs that are more frequent than those they overlap with
   don't disturb each other, so they are replaced in one round; then all pairs are counted anew.
   When none occurs twice, what is left is paired off as it stands.  Each replacement is noted with
   its place: these are the derivation positions of the new symbol.
3. Runs.  The lowest symbol that covers a run has its boundary inside.  So for each symbol, once, runs
   across its boundary are looked for: for each period up to half its length, the words around
   the boundary are compared with those one period before and after, and extended both ways by
   halving steps over names of all windows of 1, 2, 4, ... words (equal names: equal words).
4. Positions.  Runs move to all positions of their symbol, and those inside others of the same
   period go: what is left are the maximal ones.

Everything about a document is in its own row, so nothing is shuffled.  A task works on
chunks of 2 MB of text, or one document; it holds some hundred bytes for each word of a repetitive stretch.
Words are told apart by 64 bits of hash.

Defined cases: a null or empty text has no words and no runs; null ids and repeated rows are rows
like others; a long text is worked on whole; an empty table gives an empty one; other columns,
whatever their names, don't matter and aren't handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import chunks, mixed, rolling, utf8, words_of

WORD = r"[^\x20\x09-\x0D]+"
#: Pairs of a symbol and a period that are looked at together.
STEP = 1 << 20


def _repeated(values: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Where values are in a run of `size` that occurs twice or more in its part; part: ascending numbers."""
    inside = np.zeros(len(values), bool)
    if len(values) <= size:
        return inside
    window = mixed(rolling(values, size) + part[: len(values) - size + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    window[part[: len(window)] != part[size - 1 :]] = 0  # a window over an edge
    ordered = np.sort(window)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    again = again[again != 0]
    if not len(again):
        return inside
    at = np.minimum(np.searchsorted(again, window), len(again) - 1)
    hit = np.flatnonzero(again[at] == window)
    step = np.zeros(len(values) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + size, -1)
    return np.cumsum(step[:-1]) > 0


def stretches(values: np.ndarray, part: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in repetitive stretches, and the number of each one's stretch."""
    at = np.arange(len(values))
    while True:
        keep = _repeated(values, part, size)
        if keep.all() or not keep.any():
            return at[keep], part[keep]
        at, part = at[keep], part[keep]
        new = np.concatenate(([False], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])))
        values, part = values[keep], np.cumsum(new)


def grammar(symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every replacement of Re-Pair: its rule, its first place, the length of its left side and its length.

    symbols: numbers from 0; pairs don't cross parts.
    """
    log: list[tuple[np.ndarray, ...]] = []
    free = int(symbols.max()) + 1 if len(symbols) else 0
    known, names = np.zeros(0, np.int64), np.zeros(0, np.int64)  # pairs that have a rule, in order
    start, length = np.arange(len(symbols)), np.ones(len(symbols), np.int64)

    def replace(chosen: np.ndarray, rule: np.ndarray) -> None:
        nonlocal symbols, part, start, length
        log.append((rule, start[chosen], length[chosen], length[chosen] + length[chosen + 1]))
        symbols, length = symbols.copy(), length.copy()
        symbols[chosen], length[chosen] = rule, log[-1][3]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, part, start, length = symbols[keep], part[keep], start[keep], length[keep]

    while len(symbols) > 1:
        places = np.arange(len(symbols) - 1)
        fits = part[1:] == part[:-1]
        same = fits & (symbols[1:] == symbols[:-1])
        # Of a a a a the pairs at even places count.
        first = np.maximum.accumulate(np.where(same & ~np.concatenate(([False], same[:-1])), places, 0))
        fits &= ~(same & ((places - first) % 2 == 1))
        where = places[fits]
        key = (symbols[where] << 32) | symbols[where + 1]
        pairs, of, count = np.unique(key, return_inverse=True, return_counts=True)
        if not len(pairs) or count.max() < 2:
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mixed(pairs.astype(np.uint64)), count))] = np.arange(1, len(pairs) + 1)
        rank[count < 2] = 0
        weight = np.zeros(len(symbols) + 1, np.int64)
        weight[where + 1] = rank[of]
        chosen = np.flatnonzero((weight[1:-1] > weight[:-2]) & (weight[1:-1] > weight[2:]))
        chosen_key = (symbols[chosen] << 32) | symbols[chosen + 1]
        new = np.setdiff1d(chosen_key, known)
        known, names = np.concatenate((known, new)), np.concatenate((names, free + np.arange(len(new))))
        free += len(new)
        order = np.argsort(known)
        known, names = known[order], names[order]
        replace(chosen, names[np.searchsorted(known, chosen_key)])

    while len(symbols) > 1:  # what is left: one rule for each pair of neighbours
        places = np.arange(len(symbols))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], part[1:] != part[:-1])), places, 0))
        chosen = np.flatnonzero(((places - first) % 2 == 0)[:-1] & (part[1:] == part[:-1]))
        if not len(chosen):
            break
        replace(chosen, free + np.arange(len(chosen)))
        free += len(chosen)
    if not log:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*log))


class Windows:
    """Names of all windows of 1, 2, 4, ... symbols up to a length; equal windows have equal names."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [symbols.astype(np.int32)]
        while 2 << (len(self.names) - 1) <= longest:
            size, last = 1 << (len(self.names) - 1), self.names[-1].astype(np.int64)
            if len(last) <= size:
                break
            self.names.append(np.unique((last[:-size] << 32) | last[size:], return_inverse=True)[1].astype(np.int32))

    def ahead(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i < j), up to end."""
        i, j = i.copy(), j.copy()
        was = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = np.flatnonzero(j + size <= end)
                fits = fits[names[i[fits]] == names[j[fits]]]
                i[fits] += size
                j[fits] += size
        return j - was

    def back(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j (i < j), down to start."""
        i, j = i.copy(), j.copy()
        was = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = np.flatnonzero(i - size >= start)
                fits = fits[names[i[fits] - size] == names[j[fits] - size]]
                i[fits] -= size
                j[fits] -= size
        return was - i


def crossing(symbols: np.ndarray, start: np.ndarray, left: np.ndarray, length: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Runs over the boundaries of rules (each by one place): number of the rule, first and last place + 1, smallest period."""
    windows = Windows(symbols, int(length.max()) if len(length) else 1)
    periods = length // 2
    ends = np.cumsum(periods)
    found = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        flat = np.arange(low, min(low + STEP, int(ends[-1])))
        rule = np.searchsorted(ends, flat, "right")
        q = flat - (ends[rule] - periods[rule]) + 1
        middle, first, last = start[rule] + left[rule], start[rule], start[rule] + length[rule]
        # One period before the boundary, or one after it, must be inside, and the words at it must agree.
        for shift in (0, 1):
            i = middle - q * (1 - shift)
            j = i + q
            fits = np.flatnonzero((i >= first) & (j < last) if not shift else (j <= last))
            fits = fits[symbols[i[fits] - shift] == symbols[j[fits] - shift]]
            a, b = i[fits], j[fits]
            s = a - windows.back(a, b, first[fits])
            e = b + windows.ahead(a, b, last[fits])
            good = (e - s >= 2 * q[fits]) & (e - s >= min_words) & (s < middle[fits]) & (e > middle[fits])
            found.append((rule[fits][good], s[good], e[good], q[fits][good]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    rule, s, e, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, e, s, rule))
    rule, s, e, q = rule[order], s[order], e[order], q[order]
    new = np.ones(len(rule), bool)
    new[1:] = (rule[1:] != rule[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return rule[new], s[new], e[new], q[new]


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that are in no other of their period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        group = np.cumsum(np.concatenate(([False], period[1:] != period[:-1])))
        reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
        keep = np.concatenate(([True], (end[1:] > reach[:-1]) | (group[1:] != group[:-1])))
        start, end, period = start[keep], end[keep], period[keep]
    return start, end, period


def runs_of(values: np.ndarray, part: np.ndarray, min_words: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run, by start and period; values: hashes of words, part: the number of each one's text."""
    at, piece = stretches(values, part, (min_words + 1) // 2)
    symbols = np.unique(values[at], return_inverse=True)[1].astype(np.int64)
    rules, first, left, length = grammar(symbols, piece)
    long = length >= min_words
    rules, first, left, length = rules[long], first[long], left[long], length[long]
    names, sample, of = np.unique(rules, return_index=True, return_inverse=True)
    rule, s, e, q = crossing(symbols, first[sample], left[sample], length[sample], min_words)
    # To every position of the rule.
    at_rule = np.searchsorted(rule, np.arange(len(names) + 1))
    many = np.diff(at_rule)[of]
    place = np.repeat(np.arange(len(of)), many)
    run = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + at_rule[of][place] if len(place) else place
    move = first[place] - first[sample][of][place]
    s, e, q = maximal(s[run] + move, e[run] + move, q[run])
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    return at[s], at[s] + (e - s), q


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 12) -> DataFrame:
    """key, n_words, runs (array of start, length, period, by start and period) and collapsed for every row.

    collapsed: the words, joined by one space, without those that a run holds after its first period.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                hashes, _, _, before = words_of(data, offsets[a : b + 1], False)
                count = np.diff(before)
                start, end, period = runs_of(hashes, np.repeat(np.arange(b - a), count), min_words)
                row = np.searchsorted(before, start, "right") - 1
                step = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(step, start + period, 1)
                np.add.at(step, end, -1)
                kept = np.cumsum(step[:-1]) == 0
                cut = np.zeros(b - a, bool)
                cut[row] = True
                texts = []
                for k in range(b - a):
                    words = data[offsets[a + k] : offsets[a + k + 1]].tobytes().split()
                    texts.append(b" ".join(compress(words, kept[before[k] : before[k + 1]].tolist()) if cut[k] else words))
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                items = pa.StructArray.from_arrays([pa.array(start - before[row], pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.ListArray.from_arrays(bounds, items).cast(run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["key", "n_words", "runs", "collapsed"],
                )

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(find, f"key {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("key", key)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts by a hash of their id are made periodic from some word on; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the query says of runs and collapsed texts."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("r.start"), F.col("r.length"), -F.col("r.period")
    milli = F.floor(1000 * length / period).cast("long")
    return out.select(key, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
