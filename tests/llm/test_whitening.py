"""Whitening against numpy's eigenvectors, and single updates against the matrix they stand for."""

from __future__ import annotations

import math

import numpy as np
import pytest

from inkgrid.llm import whitening


def brute(rows, components=16):
    """By the definition: id, deviation, absolute values of whitened; and n, explained."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), [sum(c) for c in zip(*fit.tolist())]
    away = fit - np.array(sums) / n
    e, q = np.linalg.eigh(away.T @ away / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * e.sum()).sum()))
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x) - np.array(sums) / n) @ q[:, :k] / np.sqrt(e[:k])) for i, x in kept]
    return n, out, e[:k] / e.sum()


def compare(got, rows):
    n, want, explained = brute(rows)
    key = lambda i: (i is None, str(i))
    k = len(explained)
    assert len(got) == k * len(want)
    by = {}
    for r in got:
        by.setdefault((key(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], set()).add(round(r["whitened"], 9))
        assert r["n"] == n and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and 0 <= r["identity_error"] < 1e-10
    sign = {}
    for i, deviation, white in want:
        found = by[key(i), deviation]
        assert sorted(found) == list(range(1, k + 1))
        for c in found:
            (w,) = found[c]
            if abs(w) > 1e-6:
                sign.setdefault(c, math.copysign(1, w * white[c - 1]))
                assert w * sign[c] == pytest.approx(white[c - 1], abs=1e-7)


def test_updates_keep_the_spectrum():
    rng = np.random.default_rng(4)
    for dim in (1, 2, 5, 17):
        target = np.zeros((dim, dim))
        values, basis = np.zeros(dim), np.eye(dim)
        for step in range(80):
            v = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
            if step % 5 == 0:
                v = np.eye(dim)[rng.integers(dim)] * 3  # touches one direction
            if step % 7 == 0:
                v = basis[:, rng.integers(dim)] * 2.0
            if step % 11 == 0:
                v = np.zeros(dim)
            w = float(rng.random() + 0.1)
            target += w * np.outer(v, v)
            values, basis = whitening.updated(values.copy(), basis.copy(), v, w)
            scale = max(1e-300, np.abs(target).max())
            assert np.abs(basis.T @ basis - np.eye(dim)).max() < 1e-11
            assert np.abs(basis @ np.diag(values) @ basis.T - target).max() < 1e-11 * scale
            assert (np.diff(values) >= 0).all()


def test_merged_spectra_are_those_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (90, 6)).astype(float) + np.repeat([[0], [40]], [30, 60], axis=0)
    parts = [whitening.Spectrum(6) for _ in range(4)]
    for k, v in enumerate(x):
        parts[k // 30].add(v)
    for p in parts[1:]:
        parts[0].merge(p)
    away = x - x.mean(axis=0)
    s = parts[0]
    assert s.n == 90 and np.allclose(s.mean, x.mean(axis=0)) and np.allclose(s.basis @ np.diag(s.values) @ s.basis.T, away.T @ away)


def test_query_against_numpy(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(whitening.op13(spark, sf_dir).collect(), rows)


def test_cases(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=5).astype(np.float32).tolist()) for k in range(60)]
    rows += [(1, rows[1][1])] * 3 + [(k, rows[7][1]) for k in range(100, 160)]  # repeated rows, copies
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, rows[3][1])]
    frame = lambda r: spark.createDataFrame([(i, v, "k", 3, 4.0) for i, v in r], "vec_id long, embedding array<float>, key string, x int, n double")
    compare(whitening.whiten(frame(rows).repartition(7)).collect(), rows)
    other = rows + [(300, [1.0, 2.0]), (301, [])]
    compare(whitening.whiten(frame(other)).collect(), rows)
    flat = [(k, [float(k % 3), 0.0, 1.0]) for k in range(9)]  # rank one
    got = whitening.whiten(frame(flat)).collect()
    compare(got, flat)
    assert {r["component"] for r in got} == {1}
    for none in ([], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(frame(none)).count() == 0
    huge = whitening.whiten(frame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert huge and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)
    assert whitening.whiten(frame(rows), components=2).filter("component > 2").count() == 0


def test_deviation_is_exact_near_the_bound():
    y = np.array([[2**31 - 5, 3], [7, -9], [2**33, 1]])
    rest = np.array([11.0, -4.0])
    want = [sum((2 * a - b) ** 2 for a, b in zip(r, (11, -4))) for r in y.tolist()]
    assert whitening._deviation(y, rest, 2).to_pylist() == [w if w < 2**63 else None for w in want]
