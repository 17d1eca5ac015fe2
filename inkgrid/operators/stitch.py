"""Words into lines, lines into blocks, and greedy packing of boxes: order-dependent work inside one page."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialise
from .graph import not_independent
from .grid import meetings
from .pagewise import whole_pages
from .scan import RANGE, carried, earlier, numbered, ranged, within

BOX = ["y1", "x1", "y2", "x2"]


class Neighbours:
    """Intervals by their low ends, in classes of like length, so that those that meet a span are near each other."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        length = np.maximum(high - low, 0)
        kind = np.floor(np.log2(np.maximum(length, 1))).astype(int)
        self.classes = []
        for k in np.unique(kind):
            members = np.flatnonzero(kind == k)
            members = members[np.argsort(low[members], kind="stable")]
            self.classes.append((members.tolist(), low[members].tolist(), float(length[members].max())))

    def ranges(self, a: float, b: float) -> list[tuple[int, int]]:
        """For each class, from where to where its intervals may meet [a, b]."""
        return [(bisect_left(low, a - longest), bisect_right(low, b)) for _, low, longest in self.classes]

    def between(self, ranges: list[tuple[int, int]], seen: list[tuple[int, int]] | None) -> list[int]:
        """The members in ranges that aren't in seen, which are within ranges."""
        out = []
        for k, (first, last) in enumerate(ranges):
            members = self.classes[k][0]
            out += members[first:last] if seen is None else members[first : seen[k][0]] + members[seen[k][1] : last]
        return out


#: Candidates from which on they are tested together.
MANY = 48
Sides = tuple[float, float, float, float]


def grow_groups(box: np.ndarray, low: np.ndarray, high: np.ndarray, span: Callable[[int, Sides], tuple[float, float]], near: Callable[[int, Sides, tuple], bool]) -> tuple[np.ndarray, np.ndarray]:
    """Group number and place of joining for each box (rows y1, x1, y2, x2).

    The last box left is a group's base; then, round by round, every box left that is near joins, until none
    does.  near(base, box around the group, sides of a candidate) may get arrays of sides, too; it holds only
    for boxes whose interval from low to high meets span(base, box around the group).  Only these are looked at, and each
    comes in once, as the span grows.
    """
    group, place = [-1] * len(box), [0] * len(box)
    index, number, sides = Neighbours(low, high), 0, list(map(tuple, box.tolist()))
    for base in range(len(box) - 1, -1, -1):
        if group[base] >= 0:
            continue
        group[base], joined, around = number, 1, sides[base]
        seen, left = None, []
        while True:
            ranges = index.ranges(*span(base, around))
            if ranges != seen:
                if seen is not None:
                    ranges = [(min(r[0], s[0]), max(r[1], s[1])) for r, s in zip(ranges, seen)]
                left += [k for k in index.between(ranges, seen) if group[k] < 0]
                left.sort()
                seen = ranges
            if len(left) < MANY:
                new = [k for k in left if near(base, around, sides[k])]
            else:
                some = np.array(left)
                new = some[near(base, around, tuple(box[some].T))].tolist()
            if not new:
                break
            for k in new:
                group[k], place[k] = number, joined
                joined += 1
            y1, x1, y2, x2 = zip(*[sides[k] for k in new])
            around = (min(around[0], *y1), min(around[1], *x1), max(around[2], *y2), max(around[3], *x2))
            left = [k for k in left if group[k] < 0]
        number += 1
    return np.array(group), np.array(place)


def _parts(df: DataFrame, low: Column, high: Column, reach: float, rows: int) -> DataFrame:
    """df with __part: within a page, parts of about so many rows between which no box can reach another.

    A part ends only where the next low is further from all highs before it than reach times the
    page's largest height.  Equal places are counted before they are put in order, and the order is
    that of ranges of places, so a page may have any share of the rows.
    """
    placed = df.withColumns({"__low": low, "__high": high})
    page, order = ["page_id"], ["__low"]
    spots = placed.groupBy("page_id", "__low").agg(F.max("__high").alias("__end"), F.count("*").alias("__n"), F.max(F.col("y2") - F.col("y1")).alias("__tall"))
    spots = ranged(spots, page, order)
    tall = spots.groupBy(F.col("page_id").alias("__page")).agg(F.max("__tall").alias("__most"))
    spots = spots.join(tall, F.col("page_id").eqNullSafe(F.col("__page"))).drop("__page")
    before = within(page, order, -1)
    spots = carried(spots, page, {"__top": F.max("__end")}, {"__reached": earlier(F.max, "__top")})
    spots = carried(spots, page, {"__rows": F.sum("__n")}, {"__counted": earlier(F.sum, "__rows")})
    reached = F.greatest(F.col("__reached"), F.max("__end").over(before))
    counted = F.coalesce("__counted", F.lit(0)) + F.coalesce(F.sum("__n").over(before), F.lit(0))
    spots = spots.select("page_id", "__low", RANGE, F.when(F.col("__low") - reached > reach * F.col("__most"), counted).alias("__start"))
    spots = carried(spots, page, {"__last": F.max("__start")}, {"__before": earlier(F.max, "__last")})
    start = F.greatest(F.col("__before"), F.max("__start").over(within(page, order)))
    spots = spots.select(F.col("page_id").alias("__page"), F.col("__low").alias("__at"), F.floor(F.coalesce(start, F.lit(0)) / rows).alias("__part"))
    return placed.join(spots, F.col("page_id").eqNullSafe(F.col("__page")) & F.col("__low").eqNullSafe(F.col("__at"))).drop("__low", "__high", "__page", "__at")


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows that are sorted by keys, cut anew so that no run of equal keys is split, and where their runs begin and end."""
    left: pd.DataFrame | None = None

    def edges(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
        return np.concatenate(([0], np.flatnonzero(new), [len(pdf)]))

    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        at = edges(pdf)
        left = pdf.iloc[at[-2] :]
        if len(at) > 2:
            yield pdf.iloc[: at[-2]].reset_index(drop=True), at[:-1]
    if left is not None:
        yield left.reset_index(drop=True), np.array([0, len(left)])


#: What stitching needs to know of boxes (rows y1, x1, y2, x2): their intervals in y, and the functions of grow_groups.
Rule = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, Callable, Callable]]


def _stitch(df: DataFrame, order: str, output: str, rule: Rule, low: Column, high: Column, reach: float, rows: int) -> DataFrame:
    fields = df.schema.fields
    schema = T.StructType([*fields, T.StructField("__base", df.schema[order].dataType), T.StructField("add_order", T.IntegerType())])

    names = [*(f.name for f in fields), "__base", "add_order"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_runs(batches, ["page_id", "__part"]):
            box, numbers = pdf[BOX].to_numpy(float), pdf[order].to_numpy()
            bases, places = numbers.copy(), np.zeros(len(pdf), np.int32)
            for a, b in zip(edges[:-1], edges[1:]):
                group, place = grow_groups(box[a:b], *rule(box[a:b]))
                base = np.zeros(group.max() + 1, np.int64)
                base[group[place == 0]] = np.flatnonzero(place == 0)
                bases[a:b], places[a:b] = numbers[a:b][base[group]], place
            yield pdf.assign(__base=bases, add_order=places)[names]

    placed = _parts(df, low, high, reach, rows).repartition("page_id", "__part").sortWithinPartitions("page_id", "__part", order)
    out = materialise(placed.mapInPandas(run, schema))
    # Groups are numbered from the last base on; only bases are put in order.
    bases = out.filter("add_order = 0").select("page_id", F.col("__base"), (-F.col("__base")).alias("__down"))
    bases = numbered(ranged(bases, ["page_id"], ["__down"]), ["page_id"], ["__down"], "__number")
    bases = bases.select(F.col("page_id").alias("__page"), F.col("__base").alias("__of"), F.col("__number").cast("int").alias(output))
    joined = out.join(bases, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__base") == F.col("__of")))
    return joined.select(*[f.name for f in fields], output, "add_order")


def _line_rule(max_edge_dx: float, max_center_dy: float) -> Rule:
    def rule(box: np.ndarray):
        middles = box[:, 0] + (box[:, 2] - box[:, 0]) / 2
        middle, heights = middles.tolist(), (box[:, 2] - box[:, 0]).tolist()

        def span(base: int, around: Sides) -> tuple[float, float]:
            reach = heights[base] * max_center_dy * (1 + 1e-9)
            return middle[base] - reach, middle[base] + reach

        def near(base: int, around: Sides, c: tuple):
            dy, dx = heights[base] * max_center_dy, heights[base] * max_edge_dx
            return (abs(middle[base] - (c[0] + (c[2] - c[0]) / 2)) <= dy) & (c[1] - around[3] <= dx) & (around[1] - c[3] <= dx)

        return middles, middles, span, near

    return rule


def stitch_lines(matches: DataFrame, max_edge_dx: float = 0.5, max_center_dy: float = 0.25, part_rows: int = 200) -> DataFrame:
    """matches (page_id, seq, y1, x1, y2, x2, ...) with line_seq (order of making) and add_order; seq tells a page's matches apart.

    A page is dealt out in parts of about part_rows rows that no line can span.
    """
    middle = F.col("y1") + (F.col("y2") - F.col("y1")) / 2
    return _stitch(matches, "seq", "line_seq", _line_rule(max_edge_dx, max_center_dy), middle, middle, max_center_dy, part_rows)


def _block_rule(max_edge_dx: float, max_edge_dy: float) -> Rule:
    def rule(box: np.ndarray):
        heights = (box[:, 2] - box[:, 0]).tolist()

        def span(base: int, around: Sides) -> tuple[float, float]:
            reach = heights[base] * max_edge_dy * (1 + 1e-9)
            return around[0] - reach, around[2] + reach

        def near(base: int, around: Sides, c: tuple):
            dy, dx = heights[base] * max_edge_dy, heights[base] * max_edge_dx
            return (dy >= 0) & (c[0] - around[2] <= dy) & (around[0] - c[2] <= dy) & (c[1] - around[3] <= dx) & (around[1] - c[3] <= dx)

        return box[:, 0], box[:, 2], span, near

    return rule


def stitch_blocks(lines: DataFrame, max_edge_dx: float = 0.5, max_edge_dy: float = 0.5, part_rows: int = 200) -> DataFrame:
    """lines (page_id, line_seq, y1, x1, y2, x2, ...) with block_seq and add_order; dealt out as in stitch_lines."""
    return _stitch(lines, "line_seq", "block_seq", _block_rule(max_edge_dx, max_edge_dy), F.col("y1"), F.col("y2"), max_edge_dy, part_rows)


def highest_before(value: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each row of parts that lie one after the other, the greatest value of the rows of its part before it; very low for a first one."""
    new = np.concatenate(([True], part[1:] != part[:-1]))
    rank, number = np.unique(value, return_inverse=True)
    step = np.cumsum(new) * (len(rank) + 1)
    top = np.maximum.accumulate(number + step)
    out = np.full(len(value), -np.inf)
    out[1:] = np.where(new[1:], -np.inf, rank[(top - step)[:-1]])
    return out


def grown_pages(page: np.ndarray, seq: np.ndarray, box: np.ndarray, lines: bool, edge_dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """For each box of many pages, the row of its group's base and its place of joining, by the rules of stitch_lines or stitch_blocks.

    page rises; seq tells a page's boxes apart.  Boxes that can't reach each other are told apart by gaps.  In a cluster of
    boxes of one height where only one direction decides (words of one line, or lines above each other), and no two begin
    at one place in it, a group is a chain and its base the last one; places don't matter there and are 0.  Other
    clusters are grown as grow_groups says.  A box that lacks a side is near nothing.
    """
    lacking = np.isnan(box).any(axis=1)
    if lacking.any():
        base, place = np.arange(len(page)), np.zeros(len(page), np.int32)
        rows = np.flatnonzero(~lacking)
        if len(rows):
            found, place[rows] = grown_pages(page[rows], seq[rows], box[rows], lines, edge_dx, dy)
            base[rows] = rows[found]
        return base, place
    y1, x1, y2, x2 = box.T
    height = y2 - y1
    starts = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
    tall = np.repeat(np.maximum.reduceat(height, starts), np.diff(np.append(starts, len(page))))
    low = y1 + height / 2 if lines else y1
    order = np.lexsort((low, page))
    high = low if lines else y2
    gap = low[order] - highest_before(high[order], page[order]) > dy * (1 + 1e-9) * np.maximum(tall[order], 0)
    cluster = np.empty(len(page), np.int64)
    cluster[order] = np.cumsum(gap)  # a page's first row has a gap of infinity before it
    along, end = (x1, x2) if lines else (y1, y2)
    order = np.lexsort((along, cluster))
    c = cluster[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    size = np.diff(np.append(first, len(c)))
    least, most = lambda v: np.minimum.reduceat(v[order], first), lambda v: np.maximum.reduceat(v[order], first)
    h = most(height)
    same = (least(height) == h) & (h >= 0) & (least(end - along) >= 0)
    same &= (most(low) - least(low) <= h * dy) if lines else (most(x1) - least(x2) <= h * edge_dx)
    twin = np.zeros(len(c), bool)
    twin[1:] = (c[1:] == c[:-1]) & (along[order][1:] == along[order][:-1])
    same &= ~np.logical_or.reduceat(twin, first)
    near = (edge_dx if lines else dy) * np.repeat(h, size)
    chain = np.cumsum(along[order] - highest_before(end[order], c) > near)
    by_seq = np.lexsort((seq[order], chain))
    last = np.flatnonzero(np.append(chain[by_seq][1:] != chain[by_seq][:-1], True))
    base, place = np.empty(len(page), np.int64), np.zeros(len(page), np.int32)
    base[order] = np.repeat(order[by_seq[last]], np.diff(np.append(-1, last)))
    rule = (_line_rule if lines else _block_rule)(edge_dx, dy)
    for k in np.flatnonzero(~same).tolist():
        rows = order[first[k] : first[k] + size[k]]
        rows = rows[np.argsort(seq[rows], kind="stable")]
        group, at = grow_groups(box[rows], *rule(box[rows]))
        root = np.empty(group.max() + 1, np.int64)
        root[group[at == 0]] = rows[at == 0]
        base[rows], place[rows] = root[group], at
    return base, place


_WHOLE = {"byte", "short", "integer", "long"}


def _summed_pages(rows: DataFrame, seq: str, output: str, edge: str, separator: str, lines: bool, rest: Callable[[DataFrame], DataFrame], bounds: DataFrame | None) -> DataFrame:
    """page_id, output (place of the group), box, confidence (mean), n and value of the groups of boxes, whole pages to a task; large pages by rest."""
    slim = rows.select("page_id", seq, *BOX, "confidence", "value")
    kind = {f.name: f.dataType for f in slim.schema.fields}
    if any(kind[c].typeName() not in _WHOLE for c in (seq, *BOX)) or kind["confidence"].typeName() not in ("float", "double") or kind["value"] != T.StringType():
        return rest(rows)
    schema = T.StructType([T.StructField(n, k) for n, k in (("page_id", kind["page_id"]), (output, T.IntegerType()), *((c, kind[c]) for c in BOX), ("confidence", T.DoubleType()), ("n", T.LongType()), ("value", T.StringType()))])

    def work(ids: pa.Array, tables: list[pa.Table], edges: list[np.ndarray]) -> pa.Table:
        t, page = tables[0], np.repeat(np.arange(len(ids)), np.diff(edges[0]))
        number = t.column(seq).fill_null(-1).to_numpy()
        box = np.stack([t.column(c).to_numpy().astype(float) for c in BOX], axis=1)
        base, place = grown_pages(page, number, box, lines, 0.5, 0.25 if lines else 0.5)
        order = np.lexsort((place, box[:, BOX.index(edge)], base, -number[base], page))
        first = np.flatnonzero(np.concatenate(([True], base[order][1:] != base[order][:-1])))
        n = np.diff(np.append(first, len(order)))
        of = page[order][first]
        out = [ids.take(pa.array(of)), pa.array((np.arange(len(first)) - np.searchsorted(of, of)).astype(np.int32))]
        for c, f, side in zip(BOX, (np.fmin, np.fmin, np.fmax, np.fmax), box.T):
            v = f.reduceat(side[order], first)
            out.append(pa.array(np.nan_to_num(v).astype(np.int64), mask=np.isnan(v)).cast(t.schema.field(c).type))
        sure = t.column("confidence").combine_chunks()
        there = sure.is_valid().to_numpy(zero_copy_only=False)[order]
        some = np.add.reduceat(there.astype(np.int64), first)
        total = np.add.reduceat(sure.fill_null(0).to_numpy().astype(float)[order], first)
        out += [pa.array(total / np.maximum(some, 1), mask=some == 0), pa.array(n, pa.int64())]
        value = t.column("value").combine_chunks()
        there = value.is_valid().to_numpy(zero_copy_only=False)[order]
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(there.astype(np.int64), first))))
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), value.take(pa.array(order[there]))), separator))
        return pa.table(out, names=schema.names)

    return whole_pages([slim], work, schema, lambda large: rest(large[0]), bounds=bounds)


def summarize_groups(members: DataFrame, group: str, edge: str, separator: str) -> DataFrame:
    """page_id, group, box, confidence (mean), n and value of each group; members go by edge, then by joining."""
    ordered = F.sort_array(F.collect_list(F.struct(edge, "add_order", "value")))
    boxes = [F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2")]
    return members.groupBy("page_id", group).agg(*boxes, F.avg("confidence").alias("confidence"), F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda m: m["value"]), separator).alias("value"))


def lines_of(matches: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """page_id, line_seq, box, confidence, n and value of the lines of each page; bounds (page_id, n): as whole_pages has it."""
    return _summed_pages(matches, "seq", "line_seq", "x1", " ", True, lambda m: summarize_groups(stitch_lines(m), "line_seq", "x1", " "), bounds)


def blocks_of(lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """page_id, block_seq, box, confidence, n and value of the blocks of each page; bounds as in lines_of."""
    return _summed_pages(lines, "line_seq", "block_seq", "y1", "\n", False, lambda m: summarize_groups(stitch_blocks(m), "block_seq", "y1", "\n"), bounds)


def matches_per_page(matches: DataFrame) -> DataFrame:
    return matches.groupBy("page_id").agg(F.count("*").alias("n_matches"))


def keep_first_disjoint(boxes: DataFrame, group: list[str], order: str) -> DataFrame:
    """In order, the boxes that meet none of those kept before them in their group; touching is no meeting.

    A box that meets only later ones is kept and those go, all at once; then this is done again with what is
    left, so a group may be of any size.  Of boxes in one place of the order, the one read first is before.
    """
    rows = materialise(boxes.withColumn("__id", F.monotonically_increasing_id()))
    slim = rows.select(F.to_json(F.struct(*group)).alias("__group"), "__id", F.col(order).alias("__order"), *BOX)
    place = lambda t: F.struct(F.col(f"{t}.__order"), F.col(f"{t}.__id"))
    links = meetings(slim, None, ["__group"]).filter(place("l") < place("r")).select(F.col("l.__id").alias("a"), F.col("r.__id").alias("b"))
    gone = not_independent(links).select(F.col("id").alias("__id"))
    return rows.join(gone, "__id", "left_anti").select(*boxes.columns)


def first_disjoint(group: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Rows of boxes (y1, x1, y2, x2) that meet none of those kept before them in their group; a group's rows lie together, in order.

    In each round the first row left of every group is kept, and what it meets goes.
    """
    kept, left = [], np.arange(len(group))
    while len(left):
        g = group[left]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        new = left[first]
        kept.append(new)
        y1, x1, y2, x2 = box[left].T
        a1, b1, a2, b2 = box[new[np.cumsum(first) - 1]].T
        left = left[~first & ~((x1 < b2) & (b1 < x2) & (y1 < a2) & (a1 < y2))]
    return np.sort(np.concatenate(kept)) if kept else left


def pack_rects(sizes: DataFrame) -> DataFrame:
    """sizes (page_id, try_id, n_rows, n_cols, w, h) that fit, in order, with their cells x and y.

    Cells are tried with x over the rows' range (slowest) and y over the columns' range, as the
    rule has it; a rectangle must stay within n_cols by n_rows and meet none before it.
    """
    schema = T.StructType([*sizes.schema.fields, T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])

    def packed(rows: int, cols: int, shapes: list[tuple[int, int]]) -> list[tuple[int, int]]:
        used = [0] * cols  # for each x, the bits of its y

        def place(w: int, h: int) -> tuple[int, int]:
            for x in range(min(rows, cols - w + 1)):
                taken = 0
                for column in used[x : x + w]:
                    taken |= column
                for y in range(min(cols, rows - h + 1)):
                    if not (taken >> y) & ((1 << h) - 1):
                        for k in range(x, x + w):
                            used[k] |= ((1 << h) - 1) << y
                        return x, y
            return -1, -1

        return [place(w, h) for w, h in shapes]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_runs(batches, ["page_id"]):
            rows, cols, shapes = pdf["n_rows"].tolist(), pdf["n_cols"].tolist(), list(zip(pdf["w"].tolist(), pdf["h"].tolist()))
            at = [spot for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for spot in packed(int(rows[a]), int(cols[a]), shapes[a:b])]
            pdf = pdf.assign(x=np.array([x for x, _ in at], np.int32), y=np.array([y for _, y in at], np.int32))
            yield pdf[pdf["x"] >= 0]

    return sizes.repartition("page_id").sortWithinPartitions("page_id", "try_id").mapInPandas(pack, schema)
