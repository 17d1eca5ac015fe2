"""Scores of detected boxes and recognised words."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.boxes import intersection_over_union
from ..functions.translit import plain
from ..sources.storage import materialise
from .graph import components
from .grid import box_of, meetings
from .pagewise import whole_pages
from .stitch import whole_runs

def iou_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, class, gt_id, pred_id and iou of boxes that overlap; both tables: image_id, class, box_id, y1, x1, y2, x2."""
    met = meetings(gt, pred, ["image_id", "class"])
    return met.select("l.image_id", "l.class", F.col("l.box_id").alias("gt_id"), F.col("r.box_id").alias("pred_id"), intersection_over_union(box_of("l"), box_of("r")).alias("iou"))


def assign(left: list[int], right: list[int], weight: list[float]) -> list[bool]:
    """Which edges are in a matching of largest weight.  Nodes are numbers from 0, an edge stands once.

    Shortest augmenting paths with prices: each left node is matched in turn, if only with nothing (a node of its own).
    """
    n, m = max(left) + 1, max(right) + 1
    edges: list[list[tuple[int, float, int]]] = [[(m + i, 0.0, -1)] for i in range(n)]
    for e, (i, j, w) in enumerate(zip(left, right, weight)):
        edges[i].append((j, -w, e))
    u = [min(c for _, c, _ in es) for es in edges]
    v = [0.0] * (m + n)
    owner, by = [-1] * (m + n), [-1] * (m + n)  # the left node of a right one, and the edge between them
    mate = [-1] * n  # the right node of a left one
    for root in range(n):
        far: dict[int, float] = {}
        done: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        heap: list[tuple[float, int]] = []
        i, base = root, 0.0
        while True:
            for j, c, e in edges[i]:
                d = base + c - u[i] - v[j]
                if j not in done and d < far.get(j, math.inf):
                    far[j], back[j] = d, (i, e)
                    heapq.heappush(heap, (d, j))
            while heap[0][1] in done:
                heapq.heappop(heap)
            base, j = heapq.heappop(heap)
            if owner[j] < 0:
                break
            done[j] = base
            i = owner[j]
        u[root] += base
        for k, d in done.items():
            u[owner[k]] += base - d
            v[k] -= base - d
        while j >= 0:  # along the path back to the root
            i, e = back[j]
            owner[j], by[j] = i, e
            mate[i], j = j, mate[i]
    chosen = {by[j] for j in mate} - {-1}
    return [e in chosen for e in range(len(left))]


#: Rounds go on while they settle at least one pair in so many.
WORTH = 100


def _settled(pairs: DataFrame) -> DataFrame:
    """pairs with __settled: the pair weighs at least as much as the best others of its two boxes together, so some best pairing has it."""
    for name, box in (("g", "gt_id"), ("p", "pred_id")):
        rank = Window.partitionBy("image_id", "class", box).orderBy(F.desc("iou"), "__e")
        first = F.row_number().over(rank) == 1
        pairs = pairs.withColumns({f"__{name}_first": first, f"__{name}_other": F.when(first, F.coalesce(F.lead("iou").over(rank), F.lit(0.0)))})
    return pairs.withColumn("__settled", F.col("__g_first") & F.col("__p_first") & (F.col("iou") >= F.col("__g_other") + F.col("__p_other")))


def pair_boxes(pairs: DataFrame) -> DataFrame:
    """The pairs (image_id, class, gt_id, pred_id, iou) of a one-to-one pairing with the largest total, image by image and class by class.

    In rounds, pairs that weigh as much as all that can compete with them are settled and their boxes leave; boxes
    with one partner, stars and most others end there.  What is left goes by connected component, many to a
    task, to an exact matcher; a component is one task's work.
    """
    columns = pairs.columns
    rest = materialise(pairs.filter("iou is not null").withColumn("__e", F.monotonically_increasing_id()))
    chosen = None
    while True:
        marked = materialise(_settled(rest).select(*columns, "__e", "__settled"))
        n, settled = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("__settled").cast("long")), F.lit(0))).first()
        done = marked.filter("__settled").select(*columns)
        chosen = done if chosen is None else chosen.unionByName(done)
        if n == settled:
            return chosen
        rest = marked.filter("not __settled").drop("__settled")
        for box in ("gt_id", "pred_id"):
            rest = rest.join(done.select("image_id", "class", box), ["image_id", "class", box], "left_anti")
        rest = materialise(rest.select(*columns, "__e"))
        if settled * WORTH < n:
            break
    least = lambda box: F.min("__e").over(Window.partitionBy("image_id", "class", box))
    named = materialise(rest.withColumns({"__a": 2 * least("gt_id"), "__b": 2 * least("pred_id") + 1}))
    found = components(named.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).withColumnRenamed("id", "__a")
    dealt = named.join(found, "__a").select(*columns, "component", "__a", "__b").repartition("component").sortWithinPartitions("component")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_runs(batches, ["component"]):
            keep = np.zeros(len(pdf), bool)
            weight = pdf["iou"].to_numpy(float)
            for a, b in zip(edges[:-1], edges[1:]):
                sides = [np.unique(pdf[c].to_numpy()[a:b], return_inverse=True)[1].tolist() for c in ("__a", "__b")]
                keep[a:b] = assign(*sides, weight[a:b].tolist())
            yield pdf.loc[keep, columns]

    return chosen.unionByName(dealt.mapInPandas(match, pairs.schema))


def localization_metrics(gt: DataFrame, pred: DataFrame, iou: float = 0.5) -> DataFrame:
    """One row: n_gt, n_pred, matches, recall, precision and mean_iou (of each prediction's best); null where undefined."""
    pairs = materialise(iou_pairs(gt, pred))
    matched = pair_boxes(pairs).agg(F.coalesce(F.sum((F.col("iou") >= iou).cast("long")), F.lit(0)).alias("matches"))
    best = pairs.groupBy("image_id", "class", "pred_id").agg(F.max("iou").alias("best")).agg(F.coalesce(F.sum("best"), F.lit(0.0)).alias("best"))
    out = gt.agg(F.count("*").alias("n_gt")).crossJoin(pred.agg(F.count("*").alias("n_pred"))).crossJoin(matched).crossJoin(best)  # one row each
    return out.select(
        "n_gt", "n_pred", "matches",
        F.try_divide(F.col("matches").cast("double"), F.col("n_gt")).alias("recall"),
        F.try_divide(F.col("matches").cast("double"), F.col("n_pred")).alias("precision"),
        F.try_divide(F.col("best"), F.col("n_pred")).alias("mean_iou"),
    )


def text_match(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of by: n, raw and unicase, the shares of pairs (target, pred) that are equal, and equal in lower case and plain letters."""
    equal = lambda a, b: F.avg(F.coalesce(a == b, F.lit(False)).cast("double"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), equal(F.col("target"), F.col("pred")).alias("raw"), equal(plain(F.col("target")), plain(F.col("pred"))).alias("unicase"))


def mean_loss(batches: DataFrame, loss: str = "loss") -> DataFrame:
    return batches.agg(F.avg(loss).alias("mean_loss"))


def overlapping(page: np.ndarray, box: np.ndarray, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of boxes (y1, x1, y2, x2) of one page that share area, each pair once, in chunks.

    Boxes are put in order by one side; those that may meet a box begin before it ends.  The side that leaves fewer candidates is taken.
    """
    found = []
    for a, b in ((0, 2), (1, 3)):
        low, high = box[:, a], box[:, b]
        order = np.lexsort((low, page))
        places, of = np.unique(low, return_inverse=True)
        until = np.searchsorted(places, high)  # the first place that the box doesn't reach
        wide = len(places) + 1
        ends = np.searchsorted(page[order] * wide + of[order], page[order] * wide + until[order])
        found.append((order, np.maximum(ends - np.arange(len(order)) - 1, 0)))
    order, n = min(found, key=lambda f: f[1].sum())
    at = np.concatenate(([0], np.cumsum(n)))
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk, "right")) - 1)
        k = n[first:last]
        i = np.repeat(np.arange(first, last), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(at[first:last] - at[first], k)
        i, j = order[i], order[j]
        y1, x1, y2, x2 = box.T
        met = (x1[i] < x2[j]) & (x1[j] < x2[i]) & (y1[i] < y2[j]) & (y1[j] < y2[i])
        yield i[met], j[met]
        first = last


_WHOLE = {"byte", "short", "integer", "long"}


def collisions(boxes: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """page_id, a and b for boxes (page_id, box_id, y1, x1, y2, x2, n_rows, n_cols) of a page that overlap; b is null for one that leaves its grid.

    bounds (page_id, n): as whole_pages has it.
    """
    kind = {f.name: f.dataType for f in boxes.schema.fields}
    slim = boxes.select("page_id", "box_id", "y1", "x1", "y2", "x2", F.coalesce(F.expr("y1 < 0 or x1 < 0 or y2 > n_rows or x2 > n_cols"), F.lit(False)).cast("byte").alias("out"))
    schema = T.StructType([T.StructField("page_id", kind["page_id"]), T.StructField("a", kind["box_id"]), T.StructField("b", kind["box_id"])])

    def spread(some: DataFrame) -> DataFrame:
        both = meetings(some, None, ["page_id"]).filter("l.box_id < r.box_id").select("l.page_id", F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"))
        return both.unionByName(some.filter("out = 1").select("page_id", F.col("box_id").alias("a"), F.lit(None).cast(kind["box_id"]).alias("b")))

    if any(kind[c].typeName() not in _WHOLE for c in ("box_id", "y1", "x1", "y2", "x2")):
        return spread(slim)

    def work(ids: pa.Array, tables: list[pa.Table], edges: list[np.ndarray]) -> pa.Table:
        t, page = tables[0], np.repeat(np.arange(len(ids)), np.diff(edges[0]))
        name = t.column("box_id").combine_chunks()
        box = np.stack([t.column(c).to_numpy().astype(float) for c in ("y1", "x1", "y2", "x2")], axis=1)
        sure = ids.is_valid().to_numpy(zero_copy_only=False)[page] & name.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(box).any(axis=1)
        rows, number = np.flatnonzero(sure), name.fill_null(0).to_numpy()
        parts = []
        for i, j in overlapping(page[rows], box[rows]):
            i, j = rows[i], rows[j]
            turned = number[i] > number[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            some = number[i] < number[j]
            parts.append(pa.table([ids.take(pa.array(page[i[some]])), name.take(pa.array(i[some])), name.take(pa.array(j[some]))], names=schema.names))
        out = np.flatnonzero(t.column("out").to_numpy() == 1)
        parts.append(pa.table([ids.take(pa.array(page[out])), name.take(pa.array(out)), pa.nulls(len(out), name.type)], names=schema.names))
        return pa.concat_tables(parts)

    return whole_pages([slim], work, schema, lambda large: spread(large[0]), bounds=bounds)
