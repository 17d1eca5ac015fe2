"""Operators on tables that have their internal and output names as extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkgrid.llm import extraction, forest, kneser_ney, minhash, mixing, packing, periodic, pieces, ppm, privacy, quality, substrings, tables, whitening

NAMES = """__text __html __words __windows __h1 __lines __classes __chars __spaced __p __w __row __ref __part __key __salt __mark __last
 n_words word_chars n_symbols n_dup_lines n_repeat_words class_divergence word_divergence base_failed kept n_removed kept_sha256 c id h k key row block body sig bands
 size epochs taken target source_size piece start length ids ids_crc32 sequence_id offset begins ends component component_id n_shingles score held_out runs collapsed in0 in1""".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", "a", 1), (2, text + " more", "en", "a", 2), (3, "call me at anna@example.org " * 30, "en", "b", 3), (4, None, None, None, None), (None, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


def own(df, names=NAMES):
    """The caller's columns are as they were."""
    for r in df.collect():
        assert all(r[n] == f"mine {n}" for n in names)
    return df


def test_stages_keep_the_callers_columns(docs):
    refs = None
    for out in (quality.keep_good(docs, refs), minhash.keep_one(docs), substrings.without_repeats(docs), privacy.without_private(docs, privacy.TEST_KEY)):
        assert out.columns == docs.columns
        assert own(out).count() > 0


def test_outputs_replace_columns_of_their_name_only(docs):
    judged = quality.quality_rules(docs)
    assert judged.count() == 5 and set(judged.columns) == set(docs.columns) | set(quality.OUTPUTS)
    own(judged, [n for n in NAMES if n not in quality.OUTPUTS])
    model = pieces.model_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, model, ("ids", "decoded"))
    own(encoded, [n for n in NAMES if n != "ids"])
    assert encoded.filter("doc_id = 1 and decoded = text").count() == 1
    pages = docs.withColumn("html", F.concat(F.lit("<article><p>"), "text", F.lit("</article>")))
    own(extraction.extract(pages, output="main"))
    cut = substrings.remove_repeats(docs)
    own(cut, [n for n in NAMES if n not in ("n_words", "n_removed", "kept_sha256")])


def test_the_others_take_what_they_need(spark, docs):
    assert minhash.near_duplicates(docs).count() == 5
    assert packing.tokenise_and_pack(docs, packing.model_path("word_bpe_49k.json")).count() == 5
    assert periodic.periodic_runs(docs).count() == 5 and mixing.mix(docs).count() == 5
    assert ppm.scores(docs, F.lit(False), 2).count() == 5
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)], "vec_id long, embedding array<double>").select("*", *[F.lit(n).alias(n) for n in NAMES])
    assert whitening.whiten(vectors).count() == 80
    assert forest.neighbours(vectors, F.col("vec_id") % 20 == 0, 3).count() == 6
    assert kneser_ney.__doc__


def test_unused_names(spark):
    assert tables.unused("a", ["A", "a_", "b"]) == "a__"
    inner, names = tables.aliased(spark.createDataFrame([(1, 2)], "`a.b` int, in0 int"))
    assert inner.columns == ["in0", "in1"] and names == {"a.b": "in0", "in0": "in1"}


def test_kneser_ney_in_many_blocks_and_copies(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = kneser_ney.Model(docs.filter("doc_id % 3 = 0"))
    whole = {r["doc_id"]: r["log10_probability"] for r in kneser_ney.perplexities(docs, model).collect()}
    monkeypatch.setattr(kneser_ney, "ANSWERED", 2)
    monkeypatch.setattr(kneser_ney, "TEXTS", 1 << 15)
    monkeypatch.setattr(kneser_ney, "ROWS", 1 << 12)
    parts = {r["doc_id"]: r["log10_probability"] for r in kneser_ney.perplexities(docs, model).collect()}
    assert parts == pytest.approx(whole, rel=1e-6)
