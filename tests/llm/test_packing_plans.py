"""Plans of several kinds of histograms: whole, near the bound, and never worse than best fit."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from inkgrid.llm import packing


def histogram(kind):
    rng = np.random.default_rng(11)
    if kind == "uniform":
        x = rng.integers(1, 4097, 20000)
    elif kind == "log-normal":
        x = np.clip(np.exp(rng.normal(6, 1, 20000)), 1, 4096).astype(int)
    elif kind == "third":
        return dict(zip(rng.integers(1250, 1480, 150).tolist(), rng.integers(1, 300, 150).tolist()))
    elif kind == "halves":
        return {2049: 50, 2048: 30, 2047: 60, 1: 10}
    else:
        return dict(zip(rng.integers(1, 4097, 300).tolist(), rng.integers(1, 300, 300).tolist()))
    return dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "third", "random", "halves"])
def test_plan_is_whole_and_never_worse_than_best_fit(kind):
    h = histogram(kind)
    found = packing.plan(h)
    held = collections.Counter()
    for config, times in found:
        assert sum(n * k for n, k in config.items()) <= packing.CAPACITY and times > 0
        for n, k in config.items():
            held[n] += k * times
    assert held == h
    lengths = np.array(sorted(h))
    alone = sum(n for _, n in packing.best_fit(lengths, np.array([h[n] for n in lengths.tolist()]), packing.CAPACITY))
    total = sum(n for _, n in found)
    assert packing.least_sequences(h) <= total <= alone
    assert total <= 1.01 * packing.least_sequences(h)


def test_words_that_come_again_are_encoded_once():
    made = []
    kept = packing.Kept(lambda k: made.append(k) or k.encode(), 10)
    for i in range(100):
        assert kept["often"] == b"often" and kept[f"w{i}"] == f"w{i}".encode()
    assert made.count("often") == 1 and len(made) == 101 and len(kept) <= 10 and len(kept.before) <= 10


def test_a_task_leaves_no_tables_behind(spark, monkeypatch):
    """Workers outlive their tasks: what one task kept would stay in each of an executor's idle workers."""
    import pyarrow as pa

    tasks, path = [], packing.model_path("word_bpe_49k.json")
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run))
    packing.pieces(docs, path)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", "three 44 one"]})
    for _ in range(2):
        found = list(tasks[0](iter([batch])))
        assert found[0].column(3).to_pylist() == [3, 5]
        kept = packing.tokens(path)
        assert not (kept.words or kept.words.before or kept.parts or kept.parts.before)
