"""Files, vocabularies, labels, splits and exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pagewise import whole_pages
from ..operators.scan import numbered, ranged
from .images import FolderListing, write_files  # noqa: F401

DETECTION = "img_dimensions array<int>, img_hash string, polygons array<array<array<int>>>"


def list_images(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = (".png", ".jpg")) -> DataFrame:
    """path, name and size of image files, by name and then path; suffixes count case.  Folders are listed by tasks, files aren't read."""
    spark.dataSource.register(FolderListing)
    found = spark.read.format(FolderListing.name()).option("path", path).option("recursive", str(recursive).lower()).option("suffixes", ",".join(suffixes)).load()
    return found.orderBy("name", "path")


def catalog_by_basename(files: DataFrame, order: list[Column]) -> DataFrame:
    """One path for each name: the last in order."""
    return files.groupBy("name").agg(F.max_by("path", F.struct(*order)).alias("path"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Replaces what is there."""
    vocab.select("id", "count").write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, count long").parquet(path)


def read_det_labels(labels: DataFrame) -> DataFrame:
    """file and the parsed label of rows (id, data: JSON); data that is no JSON gives null."""
    return labels.select(F.concat("id", F.lit(".png")).alias("file"), F.from_json("data", DETECTION).alias("label"))


def read_reco_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.concat("id", F.lit(".png")).alias("file"), "label")


def write_split(labels: DataFrame, path: str) -> None:
    """One folder for each split; replaces what is there."""
    labels.write.mode("overwrite").partitionBy("split").parquet(path)


def _last(pages: DataFrame) -> DataFrame:
    """Of pages with one file name the last place: filename, page_id and sha256."""
    return pages.groupBy("filename").agg(F.max_by(F.struct("page_id", "sha256"), "place").alias("p")).select("filename", "p.page_id", "p.sha256")


_MATCH = ["seq", "y1", "x1", "y2", "x2", "confidence", "value"]


def _ordered(ids: pa.Array, t: pa.Table, edges: np.ndarray) -> pa.Table:
    """Matches by page, confidence and seq; null comes first."""
    page = pa.array(np.repeat(np.arange(len(ids)), np.diff(edges)))
    return t.take(pc.sort_indices(t.append_column("__page", page), [("__page", "ascending"), ("confidence", "ascending"), ("seq", "ascending")], null_placement="at_start"))


def export_pages(pages: DataFrame, matches: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """filename and JSON of each page: pages (page_id, filename, sha256, place), matches (page_id, seq, y1.., confidence, value).

    Matches go by confidence, then seq, and have an id each.  Of pages with one file name the last place stays.
    bounds (page_id, n): as whole_pages has it.
    """
    kind = {f.name: f.dataType for f in matches.schema.fields}
    last = _last(pages)
    fields = T.StructType([T.StructField(c, kind[c]) for c in _MATCH])
    schema = T.StructType([last.schema["page_id"], last.schema["filename"], last.schema["sha256"], T.StructField("m", T.ArrayType(fields))])

    def work(ids: pa.Array, tables: list[pa.Table], edges: list[np.ndarray]) -> pa.Table:
        t = _ordered(ids, tables[1], edges[1])
        page = np.repeat(np.arange(len(ids)), np.diff(edges[0]))
        begins, n = edges[1][page], np.diff(edges[1])[page]
        if not ids.null_count:
            lost = np.zeros(len(page), bool)
        else:  # no page has the id null
            lost = ids.is_null().to_numpy(zero_copy_only=False)[page]
        n = np.where(lost, 0, n)
        rows = np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        t = t.take(pa.array(rows)).combine_chunks()
        each = pa.StructArray.from_arrays([t.column(c).combine_chunks() for c in _MATCH], names=_MATCH)
        ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.table([ids.take(pa.array(page)), tables[0].column("filename"), tables[0].column("sha256"), pa.ListArray.from_arrays(ends, each)], names=schema.names)

    def spread(large: list[DataFrame]) -> DataFrame:
        grouped = large[1].groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("confidence", "seq", "y1", "x1", "y2", "x2", "value"))).alias("m"))
        there = F.transform(F.coalesce("m", F.array().cast(grouped.schema["m"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in _MATCH]))
        return large[0].join(grouped, "page_id", "left").select("page_id", "filename", "sha256", there.alias("m"))

    whole = whole_pages([last.select("page_id", "filename", "sha256"), matches.select("page_id", *_MATCH)], work, schema, spread, bounds=bounds)
    listed = F.transform(
        "m", lambda x: F.struct(F.md5(F.concat_ws(":", F.col("page_id"), x["seq"])).alias("id"), F.array(x["y1"], x["x1"], x["y2"], x["x2"]).alias("bbox"), x["confidence"].alias("confidence"), x["value"].alias("value"))
    )
    return whole.select("filename", F.to_json(F.struct("filename", "sha256", listed.alias("matches"))).alias("json"))


def export_lines(pages: DataFrame, matches: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """filename, line (from 0) and json: each page's JSON file line by line, a match on each, as export_pages has them.

    A large page is never in one row or one task as a whole: its matches get their places from ranges of (page, confidence, seq).
    bounds (page_id, n): as whole_pages has it.
    """
    kind = {f.name: f.dataType for f in matches.schema.fields}
    last = _last(pages).select("page_id", "filename", "sha256")
    schema = T.StructType([last.schema["page_id"], last.schema["filename"], last.schema["sha256"], T.StructField("line", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, kind[c]) for c in _MATCH]])

    def work(ids: pa.Array, tables: list[pa.Table], edges: list[np.ndarray]) -> pa.Table:
        """The matches of each file in order, with a line without a match before and after them."""
        t = _ordered(ids, tables[1], edges[1])
        page = np.repeat(np.arange(len(ids)), np.diff(edges[0]))
        begins, n = edges[1][page], np.diff(edges[1])[page]
        if ids.null_count:
            n = np.where(ids.is_null().to_numpy(zero_copy_only=False)[page], 0, n)
        file = np.repeat(np.arange(len(page)), n + 2)
        line = np.arange(len(file)) - np.repeat(np.cumsum(n + 2) - (n + 2), n + 2)
        match = (line > 0) & (line <= n[file])
        rows = t.take(pa.array(np.where(match, begins[file] + line - 1, 0), mask=~match))
        head = tables[0].take(pa.array(file))
        return pa.table([ids.take(pa.array(page[file])), head.column("filename"), head.column("sha256"), line, n[file], *[rows.column(c) for c in _MATCH]], names=schema.names)

    def spread(large: list[DataFrame]) -> DataFrame:
        own, order = large[0], ["confidence", "seq"]
        placed = numbered(ranged(large[1].join(own, "page_id"), ["filename"], order), ["filename"], order, "__place")
        counted = placed.groupBy("filename").agg(F.count("*").alias("n"))
        body = placed.join(counted, "filename").select("page_id", "filename", "sha256", (F.col("__place") + 1).alias("line"), "n", *_MATCH)
        n = F.coalesce("n", F.lit(0).cast("long"))
        ends = own.join(counted, "filename", "left").select("page_id", "filename", "sha256", F.explode(F.array(F.lit(0).cast("long"), n + 1)).alias("line"), n.alias("n"), *[F.lit(None).cast(kind[c]).alias(c) for c in _MATCH])
        return body.unionByName(ends)

    whole = whole_pages([last, matches.select("page_id", *_MATCH)], work, schema, spread, bounds=bounds)
    one = F.struct(F.md5(F.concat_ws(":", "page_id", "seq")).alias("id"), F.array("y1", "x1", "y2", "x2").alias("bbox"), "confidence", "value")
    comma = F.when(F.col("line") < F.col("n"), ",").otherwise("")
    head = F.to_json(F.struct("filename", "sha256"))
    first = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"matches":['))
    json = F.when(F.col("line") == 0, first).when(F.col("line") > F.col("n"), "]}").otherwise(F.concat(F.to_json(one), comma))
    return whole.select("filename", "line", json.alias("json"))


def write_exports(lines: DataFrame, path: str) -> None:
    """A folder for each filename, whose text files, by name, are its JSON; replaces what is there.  A large page is written by several tasks."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "filename", "line").sortWithinPartitions("filename", "line")
    dealt.select("filename", "json").write.mode("overwrite").partitionBy("filename").text(path)


def dump_json(df: DataFrame, exclude: tuple[str, ...] = (), output: str = "json") -> DataFrame:
    """df's rows as JSON with nulls, without the excluded names at any depth, be they fields or keys of maps."""
    drop = set(exclude)

    def pruned(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = [pruned(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in drop]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: pruned(x, kind.elementType))
        if isinstance(kind, T.MapType):
            kept = F.map_filter(c, lambda k, v: ~k.cast("string").isin(list(drop))) if drop else c
            return F.transform_values(kept, lambda k, v: pruned(v, kind.valueType))
        return c

    columns = [pruned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in drop]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(output))
