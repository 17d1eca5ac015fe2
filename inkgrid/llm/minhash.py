"""Near-duplicates by b-bit MinHash.

A document is the set of its word shingles.  Sets that are equal form one class, named by
the set's hash; one row stands for it.  Of each class's minima, the low bits
are kept, packed into a signature; bands of whole minima give the buckets in which
candidates meet.  For a candidate pair the bits of the two signatures that agree are
counted, corrected for chance agreement, and pairs that are surely too far apart go.
The others are confirmed on the full sets.

In a bucket not all pairs are confirmed.  Everything meets the bucket's pivot first: the
member with most company over all its buckets, as the source of a family has.  What links
to it joins its component.  Then members of different components are compared, in blocks
of bounded size, by their signatures, and what is near enough is confirmed: in a large bucket
by the block itself, to which its members' sets are sent, so that only links leave it and no
row is made for a pair that isn't one.  So every pair that could still join two components is looked at.

With the default bands a pair at the least similarity shares no bucket with a
probability of (1 - s**rows)**bands = 5e-9.

What many rows share (a hub that much is linked to, a set that many documents have) is
joined in parts (`hub_join`), so no task gets all of it.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing, whatever else has its id; with fewer words than a shingle has, all of them are one shingle; documents
with a null id come back with a null component, kept, and link nothing, as no link could
name them; repeated rows come back repeated; texts with one id are one document, linked to
all that any of them is linked to, but for its rows without words, which stay alone; a long text counts
with all its shingles; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .tables import chunks, hub_join, mixed, rolling, stored, utf8, words_of


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    percent: int = 80  # least similarity
    bands: int = 48
    rows: int = 5
    bits: int = 4  # of each minimum
    more: int = 720  # minima for the estimate alone
    #: Pairs whose estimate is so far below the least similarity aren't confirmed: over four standard deviations.
    slack: float = 0.06
    #: Members of a larger bucket that are compared at once; up to `few` are joined.
    block: int = 2048
    few: int = 48
    shingles: int = 4_000_000  # of the members of a block, roughly

    @property
    def minima(self) -> int:
        return self.bands * self.rows + self.more


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row; words are lower-cased (A-Z)."""
    for first, last in chunks(offsets):
        words, _, _, before = words_of(data, offsets[first : last + 1], lower=True)
        runs = rolling(words, size)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                whole = mixed(np.cumsum(words[a:b] * np.arange(3, 3 + b - a, dtype=np.uint64), dtype=np.uint64)[-1:] + np.uint64(b - a))
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def _class_of(s: np.ndarray) -> int:
    """A hash of the set."""
    return int(np.bitwise_xor.reduce(mixed(s + np.uint64(len(s)))).astype(np.int64)) if len(s) else 0


def _minima(s: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(salts), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):  # so that the table of values stays in the cache
        np.minimum(out, ((x[None, k : k + 512] ^ salts[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, c (hash of the set), signature (packed low bits) and keys of the bands, for every row."""
    random = np.random.default_rng(20)
    salts = random.integers(0, 1 << 32, settings.minima, dtype=np.uint32)
    factors = random.integers(0, 1 << 31, settings.minima, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    band = mixed(np.arange(1, settings.bands + 1, dtype=np.uint64))
    weights = mixed(np.arange(101, 101 + settings.rows, dtype=np.uint64)) | np.uint64(1)
    per, shingle = 64 // settings.bits, settings.shingle
    n_longs = -(-settings.minima // per)
    shift = np.uint64(settings.bits) * np.arange(per, dtype=np.uint64)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles long, c long, signature array<long>, bands array<long>"
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    bands, bits, per_band = settings.bands, settings.bits, settings.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, low, keys = [], [], [], []
            for s in shingle_sets(*utf8(batch.column(1)), shingle):
                n.append(len(s))
                hashes.append(_class_of(s))
                m = _minima(s, salts, factors)
                kept = np.zeros(n_longs * per, np.uint64)
                kept[: len(m)] = (m * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
                low.append((kept.reshape(-1, per) << shift).sum(axis=1, dtype=np.uint64))
                keys.append(mixed((m[: bands * per_band].reshape(bands, -1).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) ^ band))
            if not n:
                continue
            def lists(values: list[np.ndarray]) -> pa.Array:
                flat = np.concatenate(values).view(np.int64)
                return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(values[0]), dtype=np.int32)), pa.array(flat))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.int64()), lists(low), lists(keys)],
                names=[key, "n_shingles", "c", "signature", "bands"],
            )

    return source.mapInArrow(run, schema)


def estimate(a: Column, b: Column, settings: Settings) -> Column:
    """Similarity from two signatures: minima whose bits agree are counted, chance agreement is taken off."""
    ones = sum(1 << settings.bits * k for k in range(64 // settings.bits))
    mask = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("long")

    def differing(x: Column, y: Column) -> Column:
        folded = z = x.bitwiseXOR(y)
        for i in range(1, settings.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, i))
        return F.bit_count(folded.bitwiseAND(mask))

    # Lambdas keep the plan small, where a sum written out for every number of the signature is thousands of nodes.
    different = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-settings.bits
    return (1.0 - different / settings.minima - chance) / (1.0 - chance)


def full_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """c and s (the bytes of its sorted hashes) for the distinct classes wanted (c), and for some more.  docs: id and text; reps: c and id."""
    ids = reps.select("c", "id").join(wanted, "c", "left_semi").select("id").distinct()
    texts = docs.join(ids, "id", "left_semi").select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    shingle = settings.shingle

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = {_class_of(s): s.tobytes() for s in shingle_sets(*utf8(part.column(0)), shingle)}
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array(sets.values(), pa.binary())], names=["c", "s"])

    return texts.mapInArrow(to_sets, "c long, s binary").groupBy("c").agg(F.first("s").alias("s"))  # repeated rows are one


def _linked(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """The pairs of classes (a, b) whose full sets have the least similarity.  docs: id and text; reps: c and id; pairs: stored."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    sets, percent = full_sets(wanted, docs, reps, settings, text), settings.percent
    # The hub's set (a) comes last and is never shuffled along with the pairs.
    joined = pairs.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    joined = hub_join(joined, sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a", pairs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(x, y, percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _compared(settings: Settings):
    """Links of a block (members of chunk i against chunk j) in different components: signatures are near enough, and full sets as well."""
    bits, minima, percent = settings.bits, settings.minima, settings.percent
    chance = 2.0**-bits
    most = minima * (1 - chance - (percent / 100 - settings.slack) * (1 - chance))  # minima that may differ
    mask = np.uint64(sum(1 << bits * k for k in range(64 // bits)))

    def run(group: tuple, table: pa.Table) -> pa.Table:
        bucket, i, j = (x.as_py() for x in group)
        table = table.sort_by("c").combine_chunks()
        ids, component, n, mine = (table[c].to_numpy() for c in ("c", "component", "n", "mine"))
        sig, bands = (table[c].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("sig", "bands"))
        sig, sets = sig.view(np.uint64), table["s"].combine_chunks()
        out: list[np.ndarray] = []
        columns = np.flatnonzero(mine == j)
        for r in np.flatnonzero(mine == i):
            c = columns[columns > r] if i == j else columns
            c = c[(component[c] != component[r]) & (100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r]))]
            z = sig[c] ^ sig[r]
            folded = z.copy()
            for k in range(1, bits):
                folded |= z >> np.uint64(k)
            c = c[np.bitwise_count(folded & mask).sum(axis=1) <= most]
            if len(c):  # of the buckets that a pair shares, the first answers
                shared = bands[c] == bands[r]
                c = c[bands[r][shared.argmax(axis=1)] == bucket]
                c = c[np.array([_linked(sets[int(k)], sets[int(r)], percent) for k in c], bool)]
                out.append(np.stack((np.minimum(ids[c], ids[r]), np.maximum(ids[c], ids[r])), axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), ids.dtype)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document: key, n_shingles, component_id (the least key reachable over links) and kept (it is that one)."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    every = stored(signatures(texts, settings, "id"))
    rows = every.filter("id is not null and n_shingles > 0")
    classes = stored(rows.groupBy("c").agg(F.min("id").alias("id")))
    reps = rows.join(classes, ["c", "id"]).dropDuplicates(["c", "id"])  # one row of a class takes its signature along
    reps = stored(reps.select("c", "id", F.col("n_shingles").alias("n"), F.col("signature").alias("sig"), "bands"))
    look = reps.select("c", "n", "sig")
    banded = reps.select("c", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowd = stored(banded.join(shared, "bucket"))
    company = crowd.groupBy("c").agg(F.sum("size").alias("company"))
    pivots = crowd.join(company, "c").groupBy("bucket").agg(F.max_by("c", F.struct(F.col("company"), -F.hash("c"), "c")).alias("pivot"))
    crowd = stored(hub_join(crowd, pivots, "bucket", crowd).filter("c <> pivot"))
    whole_percent, least = settings.percent, settings.percent / 100 - settings.slack

    def near(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
        return (100 * F.least(na, nb) >= whole_percent * F.greatest(na, nb)) & (estimate(sa, sb, settings) >= least)

    star = stored(crowd.select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct())
    star = hub_join(
        star.join(look.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"),
        look.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")),
        "a",
        star,
    )
    star = star.filter(near(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))).select("a", "b")
    links = stored(confirm(stored(star), texts, reps, settings))
    # Texts with one id are one document.
    own = rows.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z").select("id", "a")
    links = stored(links.union(rows.select("id", "c").distinct().join(own, "id").select("a", F.col("c").alias("b"))))
    whole = stored(components(links).withColumnRenamed("id", "c"))

    # What the pivots left apart: members of one bucket in different components.
    inside = stored(crowd.join(whole, "c", "left").select("bucket", "c", "n", F.coalesce("component", "c").alias("component")))
    apart = inside.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("x < y")
    cells = inside.join(apart.select("bucket", "size", "shingles"), "bucket").join(reps.select("c", "sig", "bands"), "c")
    small = cells.filter(F.col("size") <= settings.few)
    left, right = (small.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("c", "component", "n", "sig")]) for x in "ab")
    unlike = (F.col("c_a") < F.col("c_b")) & (F.col("component_a") != F.col("component_b"))
    close = near(F.col("n_a"), F.col("n_b"), F.col("sig_a"), F.col("sig_b"))
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.bucket") == F.col("r.bucket")) & unlike & close).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    blocks = F.greatest(F.ceil(F.col("size") / settings.block), F.ceil(F.col("shingles") / settings.shingles)).cast("int")
    large = stored(cells.filter(F.col("size") > settings.few).withColumn("blocks", blocks))
    large = large.join(full_sets(large.select("c").distinct(), texts, reps, settings), "c")
    large = large.withColumn("mine", F.pmod(F.hash("c"), "blocks")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("bucket", F.least("mine", "x").alias("i"), F.greatest("mine", "x").alias("j"), "mine", "c", "component", "n", "sig", "bands", "s")
    linked = large.groupBy("bucket", "i", "j").applyInArrow(_compared(settings), "a long, b long")
    found = stored(confirm(stored(pairs.distinct()), texts, reps, settings).union(linked))
    if not found.isEmpty():
        whole = stored(components(links.union(found)).withColumnRenamed("id", "c"))
    least_id = whole.join(classes, "c").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = hub_join(whole, least_id, "component", whole).select("c", "component_id")
    named = classes.join(linked, "c", "left").select("c", F.coalesce("component_id", "id").alias("component_id"))
    slim = rows.select("id", "n_shingles", "c")
    out = hub_join(slim, named, "c", slim).select("id", "n_shingles", "component_id")
    rest = every.filter("id is null or n_shingles = 0").select("id", "n_shingles", "id")
    out = out.union(rest)
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that stand for their group, with the columns of docs; those with a null id stay."""
    gone = near_duplicates(docs, settings).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Settings(shingle=2))
