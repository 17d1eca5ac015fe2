"""The pipeline's stages, one after another, against brute-force versions where SQL has none."""

from __future__ import annotations

import corpus_pipeline
from inkgrid.llm import quality

from .test_operators import cut_spans, similar


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] if k in (1, 2, 3) else None
        if k == 0:
            refs = quality.references(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = {r["doc_id"] for r in quality.quality_rules(docs, refs).filter("kept").select("doc_id").collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if k == 0:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        elif k == 1:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {i for i, _, _, kept in similar(before, 5) if kept}
        elif k == 2:
            left = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
            assert left == {i: n - gone for i, n, gone, _ in cut_spans(before, 50) if gone == 0 or gone < n}
        elif k == 3:
            assert docs.count() == len(before) and docs.filter("text rlike '@mail[0-9]'").count() == 0
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_stages_on_odd_tables(spark, sf_dir):
    """Null ids and texts, repeated rows, no rows, and columns with the operators' own names."""
    prose = " ".join(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(1).collect())
    rows = [(1, prose, "en", "s", 1), (2, prose, "en", "s", 1), (None, prose, "en", None, None), (None, prose, "en", None, None), (3, None, None, None, None), (4, "", "xx", "s", 0), (1, prose, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "mine", "too", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, __text string, n_words int")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.columns == docs.columns and none.count() == 0, name
        left = spark.createDataFrame(stage(spark, left, sf_dir).collect(), docs.schema)
        assert left.columns == docs.columns and left.filter("kept <> 'mine' or __text <> 'too' or n_words <> 5").count() == 0, name
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids, key=str) == sorted([1, 1, None, None], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir)
    assert packed.filter("piece = 0").count() == 4 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
