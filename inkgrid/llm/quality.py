"""Quality rules by distribution divergence, in Spark SQL expressions only.

Each text is described by two histograms: its share of characters by class,
and its share of the language's commonest words.  Each is compared with the
language's reference by Jensen-Shannon divergence (base 2, so 0 to 1).  Short
texts give noisy histograms, so each test has a minimum length.

References are counted from all trusted texts.  The rules themselves are one scan without a
shuffle: everything about a document is computed from its own row, and the references (a row
for each language) are sent to all.

Defined cases: a null or empty text has no words and fails the base rules; a null language, or one
without trusted texts, has no reference, so only the base rules apply; a document with several
labels is trusted if all of them are good; extra columns, whatever their names, pass through; repeated rows
are judged alike, one by one; a long text is judged whole; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import aliased, stored

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Runs of each character class; what is in none of them is "other".
CLASSES = {
    "lower": r"\p{Ll}+",  # first, as most of a text is
    "upper": r"\p{Lu}+",
    "digit": r"\p{Nd}+",
    "space": f"[{SPACE}]+",
    "mark": r"""[.,;:!?'"()\-]+""",
}


#: Trusted rows that the SQL counts references from (the operator takes all), and the words of a reference.
TRUSTED, COMMON = 2_000, 12


@dataclass(frozen=True)
class Limits:
    """Lengths are in words.  A test applies from its minimum length on."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    class_from: int = 20
    class_divergence: float = 0.12
    short_from: int = 50
    short_divergence: float = 0.095
    long_from: int = 100
    long_divergence: float = 0.06


def _jensen_shannon(p: Column, q: Column) -> Column:
    """Of two arrays of shares, position by position."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2


def _stripped(df: DataFrame, text: str) -> tuple[DataFrame, list[Column], str]:
    """df with what is left of a text as one class after the other is taken out, the characters of each class, and the name of the last rest.

    No character is in two classes, so a class is counted in what those before it left.
    """
    rest, counts = text, []
    for c, p in CLASSES.items():
        df = df.withColumn(f"__no_{c}", F.regexp_replace(rest, p, ""))
        counts.append(F.length(rest) - F.length(f"__no_{c}"))
        rest = f"__no_{c}"
    return df, counts, rest


def _with_rest(a: Column) -> Column:
    return F.concat(a, F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))


def references(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """ref_lang, ref_classes, ref_words and ref_shares from all trusted texts of each language; labels: key and quality (1 is good)."""
    good = labels.groupBy(key).agg(F.min("quality").alias("q")).filter(F.col("q") == 1).select(key)
    # Never by sending the ids to all, as they grow with the input.
    rows = docs.join(good.hint("merge"), key, "left_semi").select(F.col(lang).alias("ref_lang"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("ref_lang is not null")
    stripped, counts, _ = _stripped(rows, "t")
    sums = [F.sum(c) / F.sum(F.length("t")) for c in counts]
    classes = stripped.groupBy("ref_lang").agg(F.array(*sums).alias("ref_classes"))
    words = rows.select("ref_lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(f"({WORD})"))).alias("w"))
    counts = words.groupBy("ref_lang", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.col("n").desc(), "w"))
    total = counts.groupBy("ref_lang").agg(F.sum("n").alias("total"))
    top = counts.withColumn("place", place).filter(F.col("place") <= common).groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("place", "w", "n"))).alias("top"))
    top = top.join(total, "ref_lang").select("ref_lang", F.transform("top", lambda x: x["w"]).alias("ref_words"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("ref_shares"))
    return stored(classes.join(top, "ref_lang"))  # a row for each language


def window_hashes(df: DataFrame, words: str, window: int, name: str) -> DataFrame:
    """df with the array of hashes of each run of `window` words (null for fewer words), and the columns __h1, __h2, ... on the way.

    Words are hashed once; hashes of 1, 2, 4, ... words make those of a window, as the bits of its size ask.
    Where no four words repeat, no longer run does, and the array is null as well.
    """

    def joined(a: str, b: str, by: int) -> Column:
        n = F.size(b) - by
        return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("__h1", F.when(F.size(words) >= window, F.transform(words, lambda w: F.xxhash64(w))))
    length, whole, done = 1, None, 0
    while True:
        part = f"__h{length}"
        if window & length:
            df = df.withColumn(name, F.col(part) if whole is None else joined(name, part, done))
            whole, done = name, done + length
        if 2 * length > window:
            return df
        longer = joined(part, part, length)
        df = df.withColumn(f"__h{2 * length}", longer if length < 4 else F.when(F.size(F.array_distinct(part)) < F.size(part), longer))
        length *= 2


def repeat_words(h: Column, window: int) -> Column:
    """Words inside windows whose hash occurs at least twice in the array, the first occurrence included."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # Neighbours in hash order that agree are the repeats; zipping with the shifted array compares them.
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(placed, lambda e: e.h))
    after = F.concat(F.slice(F.transform(placed, lambda e: e.h), 2, F.size(placed)), F.array(F.lit(None).cast("bigint")))
    flagged = F.filter(
        F.arrays_zip(placed.alias("e"), F.slice(before, 1, F.size(placed)).alias("b"), after.alias("a")),
        lambda z: (F.coalesce(z["e"]["h"] == z["b"], F.lit(False))) | (F.coalesce(z["e"]["h"] == z["a"], F.lit(False))),
    )
    starts = F.sort_array(F.transform(flagged, lambda z: z["e"]["i"]))
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)
    return F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(covered)


OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_divergence", "word_divergence", "base_failed", "kept"]


def quality_rules(docs: DataFrame, refs: DataFrame | None = None, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with OUTPUTS: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_divergence, word_divergence, base_failed and kept.

    refs: of `references`; without them only the base rules apply.  The divergences are null where
    there is no reference or the text has no words.  Columns of docs with those names are replaced.
    """
    inner, names = aliased(docs)
    judged = _judged(inner, refs, limits, names[text], names.get(lang))
    return judged.select(*[F.col(a).alias(c) for c, a in names.items() if c not in OUTPUTS], *OUTPUTS)


def _judged(docs: DataFrame, refs: DataFrame | None, limits: Limits, text: str, lang: str | None) -> DataFrame:
    """docs (of `aliased`) with OUTPUTS."""
    t = F.coalesce(F.col(text), F.lit(""))
    if refs is None:
        none = F.lit(None)
        out = docs.withColumns({"ref_classes": none.cast("array<double>"), "ref_words": none.cast("array<string>"), "ref_shares": none.cast("array<double>")})
    else:
        sent = refs.select(F.col("ref_lang").alias("__ref"), *[c for c in refs.columns if c != "ref_lang"])
        own = [c for c in docs.columns if c not in ("ref_classes", "ref_words", "ref_shares")]
        out = docs.select(*[F.col(f"`{c}`") for c in own]).join(F.broadcast(sent), F.col(lang) == F.col("__ref"), "left").drop("__ref")  # a row for each language
    out = out.withColumns({"__text": t, "__words": F.regexp_extract_all(t, F.lit(f"({WORD})"))})
    out = window_hashes(out, "__words", limits.window, "__windows")
    t, words = F.col("__text"), F.col("__words")
    out, counts, rest = _stripped(out, "__text")

    n_words = F.size(words)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    chars = F.length(t)
    out = out.withColumns(
        {
            "n_words": n_words.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(rest) - F.length(F.regexp_replace(rest, SYMBOLS, ""))).cast("long"),  # no symbol is in a class
            "__lines": lines,
            "n_repeat_words": repeat_words(F.col("__windows"), limits.window).cast("long"),
            "__classes": F.array(*counts),
            "__chars": chars,
            # Two spaces between words, so that each has its own on both sides.
            "__spaced": F.concat(F.lit(" "), F.lower(F.array_join(words, "  ")), F.lit(" ")),
        }
    )
    shares = F.transform(F.col("__classes"), lambda c: c / F.col("__chars"))

    def count(word: Column) -> Column:
        between = F.concat(F.lit(" "), word, F.lit(" "))
        return (F.octet_length("__spaced") - F.octet_length(F.replace(F.col("__spaced"), between, F.lit("")))) / F.octet_length(between)

    counts = F.transform("ref_words", lambda w: count(w) / F.col("n_words"))
    out = out.withColumns({"__p": F.when(F.col("n_words") > 0, shares), "__w": F.when(F.col("n_words") > 0, counts)})
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "class_divergence": _jensen_shannon(_with_rest(F.col("__p")), _with_rest(F.col("ref_classes"))),
            "word_divergence": _jensen_shannon(_with_rest(F.col("__w")), _with_rest(F.col("ref_shares"))),
            "base_failed": (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")),
        }
    )
    n = F.col("n_words")
    too_far = (
        ((n >= limits.class_from) & (F.col("class_divergence") > limits.class_divergence))
        | ((n >= limits.short_from) & (n < limits.long_from) & (F.col("word_divergence") > limits.short_divergence))
        | ((n >= limits.long_from) & (F.col("word_divergence") > limits.long_divergence))
    )
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(too_far, F.lit(False)))
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in docs.columns], "ref_classes", "ref_words", "ref_shares")


def keep_good(docs: DataFrame, refs: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that pass, as they are: columns with the names of OUTPUTS, or of anything else, are the caller's."""
    inner, names = aliased(docs)
    # The row number keeps the optimiser from moving the filter, with a copy of every expression, below the rules.
    judged = _judged(inner, refs, limits, names["text"], names.get("lang")).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("__row") >= 0)).select(*[F.col(a).alias(c) for c, a in names.items()])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    refs = references(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality_rules(docs, refs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sql(limits: Limits = Limits()) -> str:
    """DuckDB SQL for op5."""

    def quoted(s: str) -> str:
        return s.replace("'", "''")

    def rest(a: str) -> str:
        return f"list_concat({a}, [greatest(0.0, 1.0 - list_sum({a}))])"

    def jsd(p: str, q: str) -> str:
        term = "(case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end)"
        both = term.format(a="x[1]", b="x[2]") + " + " + term.format(a="x[2]", b="x[1]")
        return f"list_sum(list_transform(list_zip({rest(p)}, {rest(q)}), lambda x: {both})) / 2"

    k = limits.window
    classes = [f"(length(t) - length(regexp_replace(t, '{quoted(p)}', '', 'g')))" for p in CLASSES.values()]
    return f"""
with good as (select doc_id from labels group by doc_id having min(quality) = 1 order by md5(doc_id::varchar), doc_id limit {TRUSTED}),
gt as (select lang, coalesce(text, '') as t from documents where doc_id in (select doc_id from good) and lang is not null),
gw as (select lang, w, count(*) as n from (select lang, unnest(list_transform(regexp_extract_all(t, '{WORD}'), lambda x: lower(x))) as w from gt) group by lang, w),
gr as (select *, row_number() over (partition by lang order by n desc, w) as place, sum(n) over (partition by lang) as total from gw),
gc as (select lang, [{", ".join(f"sum({c})::double / sum(length(t))" for c in classes)}] as rc from gt group by lang),
ref as (select gr.lang, any_value(rc) as rc, list(w order by place) as rw, list(n / total::double order by place) as rs from gr join gc on gr.lang = gc.lang where place <= {COMMON} group by gr.lang),
d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
s as (select *, regexp_extract_all(t, '{WORD}') as words from d),
w as (select rid, i as pos, array_to_string(words[i:i+{k - 1}], ' ') as win
      from (select rid, words, unnest(range(1, len(words) - {k - 2})) as i from s where len(words) >= {k})),
r as (select rid, pos from (select rid, pos, count(*) over (partition by rid, win) as n from w) where n > 1),
g as (select rid, sum(least({k}, step)) as n_repeat from (select rid, coalesce(lead(pos) over (partition by rid order by pos) - pos, {k}) as step from r) group by rid),
f as (select s.rid, doc_id, s.lang, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
      length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) as n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines,
      coalesce(n_repeat, 0) as n_repeat, [{", ".join(f"{c}::double / length(t)" for c in classes)}] as p, rc, rs,
      list_transform(rw, lambda r: len(list_filter(words, lambda x: lower(x) = r))::double / len(words)) as q
      from s left join g on s.rid = g.rid left join ref on s.lang = ref.lang),
j as (select *, n_words < {limits.min_words} or 100 * n_repeat > {limits.max_repeat_percent} * n_words as base_failed,
      case when n_words > 0 then {jsd("p", "rc")} end as cd, case when n_words > 0 then {jsd("q", "rs")} end as wd from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce((n_words >= {limits.class_from} and cd > {limits.class_divergence})
   or (n_words >= {limits.short_from} and n_words < {limits.long_from} and wd > {limits.short_divergence})
   or (n_words >= {limits.long_from} and wd > {limits.long_divergence}), false) as kept
from j"""
