"""Run logs against loops, with a run that holds most rows and goes over many ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import runlog, scan


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(8)
    runs = {"hot": 900, "a": 40, "b": 1, "c": 130, None: 60, "z": 16}
    out = []
    for run, n in runs.items():
        level = 1.0
        for e in range(n):
            level *= rng.choice([1.0, 1.0, 0.97]) if run != "c" else 1.02
            out.append((run, e * 3, round(level * rng.choice([1.0, 1.0, 1.001, 1.2]), 4)))
    return out


@pytest.fixture(scope="module")
def log(spark, logs):
    rng = random.Random(1)
    return spark.createDataFrame(rng.sample(logs, len(logs)), "run_id string, epoch int, val_loss double")


def by_run(logs):
    out = {}
    for r, e, x in sorted(logs, key=lambda t: (str(t[0]), t[1])):
        out.setdefault(r, []).append((e, x))
    return out


def test_a_hot_run_is_spread(spark, log):
    rows = scan.ranged(log, ["run_id"], ["epoch"])
    sizes = [r["count"] for r in rows.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    assert rows.filter("run_id = 'hot'").select(scan.RANGE).distinct().count() > 2


def test_places(spark, log, logs):
    got = {(r["run_id"], r["epoch"]): r["place"] for r in scan.numbered(scan.ranged(log, ["run_id"], ["epoch"]), ["run_id"], ["epoch"]).collect()}
    assert got == {(run, e): k for run, rows in by_run(logs).items() for k, (e, _) in enumerate(rows)}


def test_best_checkpoints_and_early_stop(log, logs):
    best, stop = set(), {}
    for run, rows in by_run(logs).items():
        least, count = None, 0
        for e, x in rows:
            if least is None or x < least:
                best.add((run, e, x))
                least, count = x, 0
            elif x > least + 0.01:
                count += 1
                if count >= 12:
                    stop.setdefault(run, e)
        stop.setdefault(run, None)
    assert {tuple(r) for r in runlog.best_checkpoints(log).collect()} == best
    assert {r["run_id"]: r["stop_epoch"] for r in runlog.early_stop(log, 12).collect()} == stop
    assert any(stop.values()) and not all(stop.values())


@pytest.mark.parametrize("patience", [1, 3, 40])
def test_early_stop_over_many_ranges(spark, patience):
    """Long counts that start in one range and end in another, and counts that a later range resets."""
    rng = random.Random(patience)
    rows = [(1, e, 100.0 - e // 50 if e % 50 == 0 else rng.choice([100.0 - e // 50 + 0.001, 200.0])) for e in range(600)]
    least, count, stop = None, 0, None
    for _, e, x in rows:
        if least is None or x < least:
            least, count = x, 0
        elif x > least + 0.01:
            count += 1
            stop = e if count >= patience and stop is None else stop
    got = runlog.early_stop(spark.createDataFrame(rows, "run_id int, epoch int, val_loss double"), patience).first()
    assert got["stop_epoch"] == stop


def test_rolling_loss_in_blocks(log, logs):
    for block in (1, 15, 64, 1 << 16):
        got = {(r["run_id"], r["epoch"]): r["rolling"] for r in runlog.rolling_loss(log, 2000, block).collect()}
        assert len(got) == len(logs)
        for run, rows in by_run(logs).items():
            x = [v for _, v in rows]
            for k, (e, _) in enumerate(rows):
                assert got[run, e] == pytest.approx(np.mean(x[max(0, k - 19) : k + 1]))


@pytest.mark.parametrize("beta", [0.0, 0.5, 0.95, 0.9999])
def test_smoothed_loss(log, logs, beta):
    got = {(r["run_id"], r["epoch"]): r["smoothed"] for r in runlog.smoothed_loss(log, beta).collect()}
    assert len(got) == len(logs)
    for run, rows in by_run(logs).items():
        mean = 0.0
        for k, (e, x) in enumerate(rows):
            mean = beta * mean + (1 - beta) * x
            assert got[run, e] == pytest.approx(mean / (1 - beta ** (k + 1)), rel=1e-9)


def test_affine_scan_of_long_rows():
    rng = np.random.default_rng(0)
    a, b = np.where(rng.random(5000) < 0.01, 0.0, 0.95), rng.normal(size=5000)
    want, m = [], 0.0
    for x, y in zip(a, b):
        m = x * m + y
        want.append(m)
    assert np.allclose(runlog.affine_scan(a, b), want, rtol=1e-12, atol=1e-12)


def test_empty_log(spark):
    none = spark.createDataFrame([], "run_id long, epoch int, val_loss double")
    for f in (runlog.best_checkpoints, runlog.early_stop, lambda d: runlog.rolling_loss(d, 100), runlog.smoothed_loss, runlog.lr_curve_summary):
        assert f(none).count() == 0
    assert scan.numbered(scan.ranged(none.withColumn("x", F.lit(1)), ["run_id"], ["epoch"]), ["run_id"], ["epoch"]).count() == 0
