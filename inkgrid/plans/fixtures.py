"""Tables of the reference shapes, derived from the given tables by hashes that Spark and DuckDB agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LATIN, uniform, words
from ..operators.tiles import calc_windows
from ..operators.vocab import count_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(prefix: str, *keys: str) -> Column:
    return uniform(F.concat_ws(":", F.lit(prefix), *[F.col(k).cast("string") for k in keys]))


def vocab(spark, d) -> DataFrame:
    return count_words(table(spark, d, "documents"), alphabet=LATIN)


def tokens(spark, d) -> DataFrame:
    """page_id, pos and value of the words of each document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(words(F.col("text"))).alias("pos", "value"))


def bounds(spark, d) -> DataFrame:
    """page_id and n, which the words of its texts can't be more than."""
    return table(spark, d, "documents").groupBy(F.col("doc_id").alias("page_id")).agg(F.sum(F.floor((F.length("text") + 1) / 2)).alias("n"))


def matches(spark, d) -> DataFrame:
    line, col = F.floor(F.col("pos") / 8).cast("int"), F.col("pos") % 8
    y, x = 40 * line, 60 * col
    return tokens(spark, d).select(
        "page_id", F.col("pos").alias("seq"), y.alias("y1"), x.alias("x1"), (y + 20).alias("y2"), (x + 8 * F.least(F.length("value"), F.lit(7))).alias("x2"), u("m", "page_id", "pos").alias("confidence"), "value"
    )


def regular_lines(spark, d) -> DataFrame:
    """One full-width line for eight words: pitch 28, 32 more after four lines."""
    line = F.floor(F.col("pos") / 8).cast("int")
    rows = tokens(spark, d).groupBy("page_id", line.alias("line_seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ").alias("value"))
    y = F.col("line_seq") * 28 + F.floor(F.col("line_seq") / 4).cast("int") * 32
    return rows.select("page_id", "line_seq", y.alias("y1"), F.lit(0).alias("x1"), (y + 20).alias("y2"), F.lit(480).alias("x2"), u("l", "page_id", "line_seq").alias("confidence"), "value")


def page_sizes(spark, d) -> DataFrame:
    p = F.col("page_id")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), p.cast("string")).alias("filename"), (200 + (p * 137) % 5000).cast("int").alias("w"), (200 + (p * 311) % 9000).cast("int").alias("h"))


def detections(spark, d, windows: DataFrame | None = None) -> DataFrame:
    windows = calc_windows(page_sizes(spark, d)) if windows is None else windows
    w = windows.select("page_id", "window_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("det_seq"))
    k = ("page_id", "window_id", "det_seq")
    out = w.withColumns({"rx1": 0.9 * u("rx", *k), "ry1": 0.9 * u("ry", *k)})
    out = out.withColumns({"rx2": F.col("rx1") + 0.1 * u("rw", *k), "ry2": F.col("ry1") + 0.1 * u("rh", *k), "confidence": u("c", *k)})
    return out.withColumn("value", F.when(u("v", *k) < 0.1, "").otherwise(F.concat_ws("-", *k)))


def run_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("epoch"), F.col("value").alias("val_loss"))


def boxes_gt(spark, d) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("class"), F.col("event_id").alias("box_id"), n.alias("n"))
    x, y = (F.col("n") % 20 * 80).cast("int"), (F.floor(F.col("n") / 20) * 80).cast("int")
    return e.select("image_id", "class", "box_id", y.alias("y1"), x.alias("x1"), (y + 40).alias("y2"), (x + 40).alias("x2"))


def boxes_pred(spark, d) -> DataFrame:
    """Most boxes moved right by an even number, and half of them once more, moved down by an odd one: both meet their own box only."""
    right, down = (2 * F.floor(15 * u("d", "box_id"))).cast("int"), (2 * F.floor(15 * u("e", "box_id")) + 1).cast("int")
    gt = boxes_gt(spark, d)
    first = gt.filter(u("k", "box_id") < 0.8).select("image_id", "class", "box_id", "y1", (F.col("x1") + right).alias("x1"), "y2", (F.col("x2") + right).alias("x2"))
    again = gt.filter(u("j", "box_id") < 0.5).select("image_id", "class", (F.col("box_id") + 10**9).alias("box_id"), (F.col("y1") + down).alias("y1"), "x1", (F.col("y2") + down).alias("y2"), "x2")
    return first.union(again)


def boxes_between(spark, d) -> DataFrame:
    """Boxes as long as two of those on a grid of 40 are apart, so that each may meet two."""
    at = F.floor(40 * u("d", "box_id"))
    return boxes_gt(spark, d).filter(u("k", "box_id") < 0.8).select("image_id", "class", "box_id", "y1", (F.col("x1") / 2 + at).alias("x1"), "y2", (F.col("x1") / 2 + at + 44).alias("x2"))


def text_pairs(spark, d) -> DataFrame:
    r = u("t", "page_id", "pos")
    pred = F.when(r < 0.5, F.col("value")).when(r < 0.7, F.upper(F.translate("value", "ß", "s"))).when(r < 0.9, F.expr("substring(value, 1, 2)")).otherwise(F.translate("value", "éèüö", "eeuo"))
    return tokens(spark, d).select(F.concat_ws(":", "page_id", "pos").alias("row_id"), F.col("value").alias("target"), pred.alias("pred"))


def labels(spark, d) -> DataFrame:
    """id and data for documents, some texts of which are equal."""
    data = F.to_json(F.struct(F.array((F.col("doc_id") % 900).cast("int"), F.lit(600)).alias("img_dimensions"), F.sha2("text", 256).alias("img_hash"), F.array(F.array(F.array(F.lit(0), F.lit(0)))).alias("polygons")))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("id"), data.alias("data"))


def old_labels(spark, d) -> DataFrame:
    return labels(spark, d).filter("doc_id % 10 <> 0")


def image_files(spark, d) -> DataFrame:
    return labels(spark, d).filter("doc_id % 7 <> 0").select(F.col("id").alias("name"))


# ------------------------------------------------------------ the same in DuckDB


def us(prefix: str, *keys: str) -> str:
    key = " || ':' || ".join([f"'{prefix}'", *[f"({k})::varchar" for k in keys]])
    return f"((('0x' || substr(md5({key}), 1, 8))::bigint) / 4294967296.0)"


SPLIT = r"string_split_regex(coalesce(text, ''), '[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
WORDS = f"list_filter({SPLIT}, lambda x: x <> '')"
VOCAB = f"vocab as (select w as id, count(*) as count from (select unnest({WORDS}) as w from documents) where regexp_full_match(w, '[0-9A-Za-z]+') group by w)"
CAPPED = VOCAB + ", capped as (select id, count, least(count, (select trunc(count(*) * 0.0003::double)::bigint from vocab)) as weight from vocab)"
TOKENS = f"tokens as (select doc_id as page_id, unnest(range(len(ws))) as pos, unnest(ws) as value from (select doc_id, {WORDS} as ws from documents))"
MATCHES = TOKENS + f""", matches as (select page_id, pos as seq, 40 * (pos // 8) as y1, 60 * (pos % 8) as x1, 40 * (pos // 8) + 20 as y2,
  60 * (pos % 8) + 8 * least(length(value), 7) as x2, {us('m', 'page_id', 'pos')} as confidence, value from tokens)"""
SIZES = "sizes as (select page_id, 'f' || page_id as filename, (200 + (page_id * 137) % 5000)::int as w, (200 + (page_id * 311) % 9000)::int as h from pages)"


def axis_sql(size: str, name: str) -> str:
    """CTE of the windows along one axis: page_id, i, a, b, ca, cb, last."""
    n = f"(({size} - 200) / 824.0::double)"
    return f"""{name}_s as (select page_id, unnest(case when {n} >= 1 then list_concat(list_transform(range(trunc({n})::bigint), lambda x: 824::bigint),
  case when {n} - trunc({n}) > 0 then [trunc(({n} - trunc({n})) * 824)::bigint] else [] end) else [({size} - 200)::bigint] end) as s,
  unnest(range(case when {n} >= 1 then trunc({n})::bigint + (case when {n} - trunc({n}) > 0 then 1 else 0 end) else 1 end)) as i,
  (case when {n} >= 1 then trunc({n})::bigint + (case when {n} - trunc({n}) > 0 then 1 else 0 end) else 1 end) as k from sizes),
{name} as (select page_id, i, k, i * 824 as a, i * 824 + s + 200 as b, i * 824 + 100 - (case when i = 0 then 100 else 0 end) as ca,
  i * 824 + 100 + s + (case when i = k - 1 then 100 else 0 end) as cb from {name}_s)"""


WINDOWS = SIZES + ", " + axis_sql("w", "wx") + ", " + axis_sql("h", "wy") + """,
windows as (select wx.page_id, wy.i * wx.k + wx.i as window_id, wy.a as y1, wx.a as x1, wy.b as y2, wx.b as x2, wy.ca as cy1, wx.ca as cx1, wy.cb as cy2, wx.cb as cx2
  from wx join wy on wx.page_id = wy.page_id)"""
_K = ("page_id", "window_id", "det_seq")
DETECTIONS = WINDOWS + f""", dk as (select page_id, window_id, y1, x1, y2, x2, cy1, cx1, cy2, cx2, unnest(range(8)) as det_seq from windows),
dets as (select *, rx1 + 0.1 * {us('rw', *_K)} as rx2, ry1 + 0.1 * {us('rh', *_K)} as ry2, {us('c', *_K)} as confidence,
  case when {us('v', *_K)} < 0.1 then '' else page_id || '-' || window_id || '-' || det_seq end as value
  from (select *, 0.9 * {us('rx', *_K)} as rx1, 0.9 * {us('ry', *_K)} as ry1 from dk)),
placed as (select *, rx1 * (x2 - x1) + x1 as px1, rx2 * (x2 - x1) + x1 as px2, ry1 * (y2 - y1) + y1 as py1, ry2 * (y2 - y1) + y1 as py2 from dets where value <> ''),
covered as (select * from placed where (px1 + px2) / 2 between cx1 and cx2 and (py1 + py2) / 2 between cy1 and cy2)"""
LOG = "log as (select user_id as run_id, row_number() over (partition by user_id order by event_id) - 1 as epoch, value as val_loss from events)"
GT = """gt as (select image_id, class, box_id, 80 * (n // 20) as y1, 80 * (n % 20) as x1, 80 * (n // 20) + 40 as y2, 80 * (n % 20) + 40 as x2 from
  (select user_id as image_id, event_type as class, event_id as box_id, row_number() over (partition by user_id order by event_id) - 1 as n from events))"""
PRED = GT + f""", pred as (select image_id, class, box_id, y1, x1 + s as x1, y2, x2 + s as x2 from
  (select *, 2 * floor(15 * {us('d', 'box_id')})::int as s from gt where {us('k', 'box_id')} < 0.8)
  union all select image_id, class, box_id + 1000000000, y1 + s, x1, y2 + s, x2 from
  (select *, 2 * floor(15 * {us('e', 'box_id')})::int + 1 as s from gt where {us('j', 'box_id')} < 0.5))"""
IOU = PRED + """, iou as (select gt.image_id, gt.class, gt.box_id as gt_id, pred.box_id as pred_id,
  (least(gt.x2, pred.x2) - greatest(gt.x1, pred.x1)) * (least(gt.y2, pred.y2) - greatest(gt.y1, pred.y1)) as i from gt join pred
  on gt.image_id = pred.image_id and gt.class = pred.class and gt.x1 < pred.x2 and pred.x1 < gt.x2 and gt.y1 < pred.y2 and pred.y1 < gt.y2),
pairs as (select image_id, class, gt_id, pred_id, i / (3200.0 - i) as iou from iou)"""
LABELS = "labels_ as (select doc_id, sha256(text) as id, (doc_id % 900)::int as w from documents)"
