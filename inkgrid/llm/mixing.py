"""Mixing sources to target weights: exponential keys, prefix sums to budgets of words, whole epochs first.

A source's target is its share of all words by weight, at most `most` times what it has; what is
cut off goes to the others by weight.  That is filling to one level: a source gets weight * level,
or its cap where this is less.  Sources are put in the order in which they reach their caps, and
running sums give the level that each would see if those before it were full; the first that
isn't full at its own level has the level of all.

A document is taken once for each whole epoch in its source's target.  The rest of the target is a
sample without replacement by Efraimidis and Spirakis: a document's key is -ln(u) / weight, with u
from a hash of its id and text and its quality as weight; the least keys are taken until the
budget is used up, and the document at the edge gives the words that are left.

Only rows of numbers are sorted, by range over source and key, so a source may hold any share of
all rows; running sums need one row for each range, and nothing is gathered.  SQL functions only.

Defined cases: a null text has no words and is never taken; a null source is a source of its own, the
last; null ids are ids like others; repeated rows are taken one by one, in any order, with the same
rows as result; long texts count like others; an empty table gives an empty one; other columns
don't matter, and rows=True hands them on in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_sums
from .tables import hub_join, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Signs and digits, of which good prose has few.
SIGNS = "#*$%&|<>0123456789"
#: Hexadecimal digits of a hash that make a number between 0 and 1.
DIGITS = 13


def quality(text: Column) -> Column:
    """1 for texts without signs and digits, 1/21 for texts of nothing else."""
    chars = F.length(text)
    return F.coalesce(1.0 / (1.0 + F.lit(20.0) * (chars - F.length(F.translate(text, SIGNS, ""))) / F.greatest(chars, F.lit(1))), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (k, source, source_size) with upto (the sizes up to and with it, by code point) and target."""
    ranked = sources.withColumns({"__last": F.col("source").isNull(), "__one": F.lit(1).cast("long")})
    ranked = running_sums(ranked, ["__last", "source"], {"__rank": "__one", "upto": "source_size"})
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("__weight", share).withColumn("__full_at", most * F.col("source_size") / F.col("__weight"))
    filled = stored(running_sums(ranked, ["__full_at", "__rank"], {"__sizes": "source_size", "__weights": "__weight"}))
    total = filled.agg(F.sum("source_size").alias("__all"), F.sum("__weight").alias("__all_weights"))
    seen = filled.crossJoin(F.broadcast(total))  # one row
    level = (F.col("__all") - most * (F.col("__sizes") - F.col("source_size"))) / (F.col("__all_weights") - (F.col("__weights") - F.col("__weight")))
    first = seen.withColumn("__level", level).filter(F.col("__level") <= F.col("__full_at")).agg(F.min_by("__level", F.struct("__full_at", "__rank")).alias("__level"))
    out = filled.crossJoin(F.broadcast(first))  # one row
    cap = (most * F.col("source_size")).cast("double")
    return out.select("k", "source_size", "upto", F.least(F.col("__weight") * F.col("__level"), cap).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole ones), taken (words) and, if asked for, row for every document.

    docs: doc_id, source, text.  weight: of a document in the sample, above 0 (default: quality).
    """
    text = F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(mark, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    measured = docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("k"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        mark.alias("__mark"),
        (-F.log(u) / (quality(text) if weight is None else weight)).alias("__key"),
        F.monotonically_increasing_id().alias("__salt"),  # deals out rows that are the same in all else
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []),
    )
    measured = stored(measured)
    sources = targets(measured.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, most)
    placed = running_sums(measured.withColumn("__last", F.col("source").isNull()), ["__last", "source", "__key", "__mark", "doc_id", "__salt"], {"__upto": "size"})
    out = hub_join(placed, sources, "k", measured)
    before = F.col("__upto") - F.col("size") - (F.col("upto") - F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - before))
    out = out.withColumn("epochs", epochs).withColumn("taken", taken.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", *(["row"] if rows else []))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_sql() -> str:
    return f"""with t as (select doc_id, source, coalesce(text, '') as text from documents),
m as (select doc_id, source, len(regexp_extract_all(text, '{WORD}'))::bigint as size, md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(text)) as mark,
  1.0::double / (1.0::double + 20.0::double * (length(text) - length(translate(text, '{SIGNS}', ''))) / greatest(length(text), 1)) as quality from t),
keyed as (select *, -ln((('0x' || substr(mark, 1, {DIGITS}))::bigint + 0.5::double) / {16**DIGITS}::double) / quality as key from m),
s as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight from m group by source),
f as (select *, 3 * source_size / weight as full_at, row_number() over (order by source is null, source) as rank from s),
b as (select *, coalesce(sum(source_size) over w, 0)::bigint as sizes, coalesce(sum(weight) over w, 0) as weights from f window w as (order by full_at, rank rows between unbounded preceding and 1 preceding)),
l as (select *, ((select sum(source_size) from f)::bigint - 3 * sizes) / ((select sum(weight) from f) - weights) as level from b),
v as (select arg_min(level, (full_at, rank)) as level from l where level <= full_at),
g as (select source, source_size, least(weight * v.level, (3 * source_size)::double) as target from f, v),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from g),
p as (select doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::bigint as budget,
  (sum(size) over (partition by e.source order by key, mark, doc_id rows unbounded preceding) - size)::bigint as before
  from keyed join e on keyed.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::bigint as taken from p"""
