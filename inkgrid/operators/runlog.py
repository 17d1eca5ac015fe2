"""Training logs: rows (run_id, epoch, val_loss, ...), ordered by epoch within a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.storage import materialise
from .scan import RANGE, carried, earlier, numbered, ranged, with_halo, within


def lr_ramp(start: float, end: float, n: int | Column) -> Column:
    """An array of n rates that rise by one factor from start to end; a single rate is the start."""
    n = F.lit(n) if isinstance(n, int) else n
    share = lambda i: F.when(n > 1, i / (n - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.lit(start) * F.pow(F.lit(end / start), share(i)))


RUN, ORDER = ["run_id"], ["epoch"]


def _with_best(log: DataFrame) -> DataFrame:
    """log by ranges, with best: the least loss before, in the run."""
    rows = carried(ranged(log, RUN, ORDER), RUN, {"__min": F.min("val_loss")}, {"__least": earlier(F.min, "__min")})
    return rows.withColumn("best", F.least(F.col("__least"), F.min("val_loss").over(within(RUN, ORDER, -1)))).drop("__least")


def best_checkpoints(log: DataFrame) -> DataFrame:
    """Epochs whose loss is below all before.  A run's epochs tell its rows apart; a run may have any share of the rows."""
    return _with_best(log).filter(F.col("best").isNull() | (F.col("val_loss") < F.col("best"))).select(*log.columns)


def early_stop(log: DataFrame, patience: int = 5, min_delta: float = 0.01) -> DataFrame:
    """run_id and stop_epoch (null if it never stops) of every run.

    A new minimum resets the count, a loss above minimum + min_delta adds one, others change nothing.
    What a range of rows does to the count is whether it resets it, and what it adds since.
    """
    marked = _with_best(log)
    new = F.coalesce(F.col("best").isNull() | (F.col("val_loss") < F.col("best")), F.lit(False))
    bad = F.coalesce(~new & (F.col("val_loss") > F.col("best") + min_delta), F.lit(False))
    marked = marked.withColumns({"new": new.cast("int"), "bad": bad.cast("int")}).withColumn("part", F.sum("new").over(within(RUN, ORDER)))
    since = Window.partitionBy(RANGE, *RUN, "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("count", F.sum("bad").over(since))
    # A range hands on the count at its end, which goes on from before only if nothing in the range resets it.
    end = F.max_by("count", "epoch")
    each = {"__end": end, "__resets": F.max("new")}

    carry = {
        "__before": lambda w: F.coalesce(earlier(F.sum, "__end")(w), F.lit(0)),
        "__reset_at": lambda w: F.when(F.col("__resets") == 1, F.col("__before")),
        "__in": lambda w: F.col("__before") - F.coalesce(F.last("__reset_at", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }
    counted = carried(counted, RUN, each, carry)
    count = F.col("count") + F.when(F.col("part") == 0, F.coalesce("__in", F.lit(0))).otherwise(0)
    stops = F.when((F.col("bad") == 1) & (count >= patience), F.col("epoch"))
    return counted.groupBy("run_id").agg(F.min(stops).alias("stop_epoch"))


def rolling_loss(log: DataFrame, n_batches: int, block: int = 1 << 16) -> DataFrame:
    """log with rolling: the mean of the last max(n_batches // 100, 15) losses.

    A run is dealt out in blocks of rows, each with the rows before it that its means need.
    """
    width = max(n_batches // 100, 15)
    rows = with_halo(numbered(ranged(log, RUN, ORDER), RUN, ORDER, "__place"), "__place", width - 1, max(block, width))
    last = Window.partitionBy(*RUN, "__block").orderBy("__place").rowsBetween(-(width - 1), 0)
    return rows.withColumn("rolling", F.avg("val_loss").over(last)).filter("not __copy").select(*log.columns, "rolling")


def affine_scan(factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """m, with m[i] = factors[i] * m[i - 1] + terms[i], in doubling steps; a factor of 0 starts anew."""
    a, b, step = factors.copy(), terms.copy(), 1
    while step < len(a) and a[step:].any():
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        a[:step] = 0.0
        step *= 2
    return b


def _smoothed(log: DataFrame, beta: float) -> DataFrame:
    """run_id, epoch, val_loss, i (place in the run, from 0) and smoothed.

    Rows are dealt out in blocks by range, so a run may span blocks.  A block turns the mean that
    comes in into beta^n * mean + own; one such pair for each block gives the others their start.
    """
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.select("run_id", "epoch", F.col("val_loss").cast("double").alias("val_loss"))
    dealt = rows.repartitionByRange(n, "run_id", "epoch").sortWithinPartitions("run_id", "epoch").withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("__k", T.LongType()), T.StructField("__own", T.DoubleType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the run, number and mean of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0)
            code = pc.fill_null(runs.dictionary_encode().indices, -1).to_numpy()
            new = np.concatenate(([True], code[1:] != code[:-1]))
            goes_on = before is not None and runs[0].as_py() == before[0]
            place = np.arange(batch.num_rows)
            first = np.maximum.accumulate(np.where(new, place, 0))
            k = place - first + 1
            mean = affine_scan(np.where(new, 0.0, beta), (1 - beta) * np.asarray(batch.column(2).to_numpy(zero_copy_only=False), float))
            if goes_on:
                head = first == 0
                mean[head] += beta ** k[head] * before[2]
                k[head] += before[1]
            before = (runs[-1].as_py(), int(k[-1]), float(mean[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int64()), pa.array(mean)], names=[*batch.schema.names, "__k", "__own"])

    own = materialise(dealt.mapInArrow(block, schema))
    ends = own.groupBy("run_id", "__part").agg(F.max(F.struct("__k", "__own")).alias("e")).select("run_id", "__part", "e.*")
    ends = ends.withColumn("__n", F.count("*").over(Window.partitionBy("run_id"))).filter("__n > 1").drop("__n")  # at most two rows for each block

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        before, means = [0], [0.0]
        for k, x in zip(pdf["__k"].tolist(), pdf["__own"].tolist()):
            before.append(before[-1] + k)
            means.append(beta**k * means[-1] + x)
        return pdf[["run_id", "__part"]].assign(__before=before[:-1], __mean=means[:-1])

    fields = [own.schema["run_id"], own.schema["__part"], T.StructField("__before", T.LongType()), T.StructField("__mean", T.DoubleType())]
    starts = ends.groupBy("run_id").applyInPandas(start, T.StructType(fields))
    starts = starts.select(F.col("run_id").alias("__run"), F.col("__part").alias("__of"), "__before", "__mean", F.lit(True).alias("__in"))
    out = own.join(F.broadcast(starts), (F.col("__part") == F.col("__of")) & F.col("run_id").eqNullSafe(F.col("__run")), "left")
    mean = F.when(F.col("__in"), F.col("__own") + F.pow(F.lit(beta), F.col("__k")) * F.col("__mean")).otherwise(F.col("__own"))
    i = F.coalesce("__before", F.lit(0)) + F.col("__k") - 1
    return out.select("run_id", "epoch", "val_loss", i.alias("i"), (mean / (1 - F.pow(F.lit(beta), i + 1))).alias("smoothed"))


def smoothed_loss(log: DataFrame, beta: float = 0.95) -> DataFrame:
    """log (run_id, epoch, val_loss) with smoothed: the exponential mean with bias correction."""
    return _smoothed(log, beta).drop("i")


def lr_curve_summary(log: DataFrame, beta: float = 0.95) -> DataFrame:
    """run_id, best_epoch, lowest and peak of the smoothed curve without its ends; the peak is at or before the lowest point."""
    s = materialise(_smoothed(log, beta))
    s = s.join(s.groupBy("run_id").agg(F.count("*").alias("n")), "run_id")
    head, tail = F.least(F.floor(F.col("n") / 10), F.lit(10)), F.when(F.col("n") >= 20, F.least(F.floor(F.col("n") / 20), F.lit(5))).otherwise(0)
    cut = s.filter((F.col("i") >= head) & (F.col("i") < F.col("n") - tail))
    low = cut.groupBy("run_id").agg(F.min(F.struct("smoothed", "epoch")).alias("low"))
    joined = cut.join(low, "run_id")
    return joined.groupBy("run_id").agg(F.first("low.epoch").alias("best_epoch"), F.first("low.smoothed").alias("lowest"), F.max(F.when(F.col("epoch") <= F.col("low.epoch"), F.col("smoothed"))).alias("peak"))
