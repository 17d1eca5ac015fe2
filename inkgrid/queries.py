"""Every operator as a query over the given tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import boxes as bx
from .functions import text as tx
from .operators import draw, labels, ocr, pixels, prefix, runlog, score, stitch, tiles, vocab
from .plans import fixtures as fx
from .plans import pages as pg
from .sources import images, storage
from .sources import tables as src
from .streaming import tables as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flat(df: DataFrame, column: str, prefix_: str = "") -> DataFrame:
    return df.select("*", *[F.col(f"{column}.{c}").alias(f"{prefix_}{c}") for c in ("y1", "x1", "y2", "x2")]).drop(column)


def _folder(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ vocabularies

W = f"with {fx.VOCAB} "
C = f"with {fx.CAPPED} "


@query("io1_read_corpora", "select 'question' as source, text from benchmark union all select 'text', text from documents union all select 'translation', text from conversations")
def io1(s, d):
    t = fx.table
    talk = t(s, d, "conversations").select(F.struct(F.col("text").alias("ko")).alias("translation"))
    return vocab.read_corpora([("question", t(s, d, "benchmark"), F.col("text")), ("text", t(s, d, "documents"), F.col("text")), ("translation", talk, F.col("translation.ko"))])


@query("s1_tokenize", f"select doc_id, len({fx.WORDS})::bigint as n_words from documents")
def s1(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))


@query("s2_strip_punctuation", f"select w, w as run, regexp_replace(w, '[!-/:-@\\[-`{{-~]', '', 'g') as charclass from (select distinct unnest({fx.WORDS}) as w from documents)")
def s2(s, d):
    w = tx.tokenize(fx.table(s, d, "documents"), "text", "w").select("w").distinct()
    return w.select("w", tx.strip_punctuation(F.col("w")).alias("run"), tx.strip_punctuation(F.col("w"), "charclass").alias("charclass"))


@query("s3_alphabet_filter", f"select w from (select distinct unnest({fx.WORDS}) as w from documents) where regexp_full_match(w, '[0-9A-Za-z]+')")
def s3(s, d):
    return tx.tokenize(fx.table(s, d, "documents"), "text", "w").select("w").distinct().filter(tx.in_alphabet(F.col("w"), tx.LATIN))


@query("a1_count_words", W + "select id, count from vocab")
def a1(s, d):
    return fx.vocab(s, d)


@query("a2_apply_floor", W + "select id, max(count) as count from (select * from vocab union all select unnest(string_split('" + tx.LATIN + "', '')) as id, 1000 as count) group by id")
def a2(s, d):
    return vocab.apply_floor(fx.vocab(s, d), hangul=0)


#: Latin letters of the texts written as syllables; the last of these is outside the default set.
_SYLLABLES = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허갂"
_LETTERS = "abcdefghijklmnoprstuvwxyzéüñq"
H = f"""with hv as (select id, sum(n)::bigint as count from (select translate(w, '{_LETTERS}', '{_SYLLABLES}') as id, n from
  (select w, count(*) as n from (select unnest({fx.WORDS}) as w from documents) group by w)) where regexp_full_match(id, '[{tx.hangul_syllables()}0-9A-Za-z]+') group by id) """


def _korean(s, d):
    docs = fx.table(s, d, "documents").withColumn("text", F.translate("text", _LETTERS, _SYLLABLES))
    return vocab.count_words(docs)


@query("s3_korean_words", H + "select id, count from hv")
def s3k(s, d):
    return _korean(s, d)


@query("a2_korean_floor", H + f"select id, max(count) as count from (select * from hv union all select unnest(string_split('{tx.hangul_syllables()}', '')) as id, 10 as count union all select unnest(string_split('{tx.LATIN}', '')), 1000) group by id")
def a2k(s, d):
    return vocab.apply_floor(_korean(s, d))


@query("a3_vocab_summary", W + "select count(*) as n_words, sum(count)::bigint as total from vocab")
def a3(s, d):
    return vocab.vocab_summary(fx.vocab(s, d))


@query("a4_cap_frequency", C + "select * from capped")
def a4(s, d):
    return vocab.cap_frequency(fx.vocab(s, d))


@query("a4_cap_report", C + "select trunc(count(*) * 0.0003::double)::bigint as cap, sum(weight)::bigint as total, round(trunc(count(*) * 0.0003::double) / nullif(sum(weight), 0), 9) as share from capped")
def a4r(s, d):
    return vocab.cap_report(vocab.cap_frequency(fx.vocab(s, d))).withColumn("share", F.round("share", 9))


@query("io4_io5_vocab_round_trip", W + "select id, count from vocab")
def io45(s, d):
    path = _folder(s, "vocab")
    src.write_vocab(fx.vocab(s, d), path)
    return src.read_vocab(s, path)


@query("w1_running_weight", C + "select id, weight, sum(weight) over (order by id rows unbounded preceding)::bigint as running from capped")
def w1(s, d):
    return prefix.running_sum(vocab.cap_frequency(fx.vocab(s, d)), ["id"], "weight").select("id", "weight", "running")


@query("j6_weighted_draw", C + f""", run as (select id, high - weight as low, high from (select id, weight, sum(weight) over (order by id rows unbounded preceding) as high from capped)),
x as (select event_id, {fx.us('draw', 'event_id')} * (select sum(weight) from capped) as x from events)
select event_id, id as drawn from x join run on x >= low and x < high""")
def j6(s, d):
    return draw.weighted_draw(vocab.cap_frequency(fx.vocab(s, d)), fx.table(s, d, "events").select("event_id"), F.concat(F.lit("draw:"), F.col("event_id").cast("string")))


@query("j7_categorical_draw", f"select event_id, case when x < 80 then 'image' when x < 90 then 'fill' else 'none' end as choice from (select event_id, {fx.us('bg', 'event_id')} * 99 as x from events)")
def j7(s, d):
    return draw.categorical_draw(fx.table(s, d, "events").select("event_id"), draw.percent_counts(0.8, 0.1), F.concat(F.lit("bg:"), F.col("event_id").cast("string")))


# ------------------------------------------------------------ boxes, detections, windows

M = f"with {fx.MATCHES} "
D = f"with {fx.DETECTIONS} "


@query("s4_poly_bbox", M + "select page_id, seq, y1, x1, y2, x2 from matches")
def s4(s, d):
    m = fx.matches(s, d)
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y1"))])
    return flat(m.select("page_id", "seq", bx.poly_bbox(corners).alias("box")), "box")


@query("s5_box_measures", M + "select page_id, seq, x2 - x1 as width, y2 - y1 as height, x1 + (x2 - x1) / 2 as center_x, y1 + (y2 - y1) / 2 as center_y from matches")
def s5(s, d):
    m = fx.matches(s, d).withColumn("box", F.struct("y1", "x1", "y2", "x2"))
    return bx.box_measures(m).select("page_id", "seq", "width", "height", "center_x", "center_y")


@query("s6_label_box", M + "select m.page_id, seq, greatest(y1 - 1, 0) as y1, greatest(x1 - 1, 0) as x1, least(y2 + 1, 40 * (last // 8) + 20) as y2, least(x2 + 1, 469) as x2 from matches m join (select page_id, max(seq) as last from matches group by page_id) l on m.page_id = l.page_id")
def s6(s, d):
    """A page ends with its last line."""
    m = fx.matches(s, d)
    tall = m.groupBy("page_id").agg((40 * F.floor(F.max("seq") / 8) + 21).cast("int").alias("tall"))
    m = m.join(tall, "page_id").select("page_id", "seq", bx.label_box(F.struct("y1", "x1", "y2", "x2"), F.lit(470), F.col("tall")).alias("box"))
    corner = bx.box_polygon(F.col("box"))
    box = F.struct(corner[0][1].alias("y1"), corner[0][0].alias("x1"), corner[2][1].alias("y2"), corner[2][0].alias("x2"))
    return flat(m.select("page_id", "seq", box.alias("box")), "box")


@query("s7_interval_gap", M + "select page_id, seq, greatest(0, bx1 - x2, x1 - bx2) as gap from (select *, lead(x1) over w as bx1, lead(x2) over w as bx2 from matches window w as (partition by page_id order by seq)) where bx1 is not null")
def s7(s, d):
    to = lambda c: F.lead(c).over(Window.partitionBy("page_id").orderBy("seq"))
    pair = fx.matches(s, d).withColumns({"b1": to("x1"), "b2": to("x2")}).filter("b1 is not null")
    return pair.select("page_id", "seq", bx.interval_gap(F.col("x1"), F.col("x2"), F.col("b1"), F.col("b2")).alias("gap"))


@query("s10_contrast", "select page_id, round((greatest(p, q) + 0.05) / (least(p, q) + 0.05), 6) as contrast from (select page_id, " + ", ".join(
    " + ".join(f"{w} * (case when {c} / 255.0 < 0.03928 then {c} / 255.0 / 12.92 else pow(({c} / 255.0 + 0.055) / 1.055, 2.4) end)" for w, c in ((0.2126, a), (0.7152, b), (0.0722, c_))) + f" as {n}"
    for n, a, b, c_ in (("p", "(page_id * 7 % 256)", "(page_id * 11 % 256)", "(page_id * 13 % 256)"), ("q", "(page_id * 3 % 256)", "(page_id * 5 % 256)", "(page_id * 17 % 256)"))) + " from pages)")
def s10(s, d):
    return _colours(s, d).select("page_id", F.round(bx.contrast(F.col("a"), F.col("b")), 6).alias("contrast"))


def _colours(s, d):
    p = F.col("page_id")
    rgb = lambda *k: F.struct(*[(p * m % 256).cast("int").alias(c) for c, m in zip("rgb", k)], F.lit(200).alias("a"))
    return fx.table(s, d, "pages").select("page_id", rgb(7, 11, 13).alias("a"), rgb(3, 5, 17).alias("b"))


@query("s11_contrast_filter", "select page_id from (" + ORACLES["s10_contrast"] + ") where contrast * (200 / 255.0) * (200 / 255.0) >= 3")
def s11(s, d):
    return bx.contrast_filter(_colours(s, d), alpha_scale=255).select("page_id")


@query("s12_filter_detections", D + "select page_id, window_id, det_seq from dets where value <> '' and confidence >= 0.25")
def s12(s, d):
    return bx.filter_detections(fx.detections(s, d), 0.25).select("page_id", "window_id", "det_seq")


@query("s13_to_page_box", D + "select page_id, window_id, det_seq, trunc(py1)::int as y1, trunc(px1)::int as x1, trunc(py2)::int as y2, trunc(px2)::int as x2 from placed")
def s13(s, d):
    placed = bx.to_page_box(bx.filter_detections(fx.detections(s, d)).join(tiles.calc_windows(fx.page_sizes(s, d)), ["page_id", "window_id"]))
    return flat(placed.select("page_id", "window_id", "det_seq", "page_box"), "page_box")


@query("s14_resized_dims", f"with {fx.SIZES} select page_id, trunc(w * 0.37::double)::int as w, trunc(h * 0.37::double)::int as h from sizes")
def s14(s, d):
    return fx.page_sizes(s, d).select("page_id", bx.resized_dims(F.col("w"), F.col("h"), F.lit(0.37)).alias("r")).select("page_id", "r.w", "r.h")


@query("s15_span_filter", f"with e as (select event_id, floor({fx.us('a', 'event_id')} * 100)::int as a, floor({fx.us('b', 'event_id')} * 100)::int as b from events) select event_id, least(a, b) as x1, greatest(a, b) as x2 from e where a <> b and (greatest(a, b) - least(a, b)) / 100.0 >= 0.2")
def s15(s, d):
    e = fx.table(s, d, "events").select("event_id", F.floor(fx.u("a", "event_id") * 100).cast("int").alias("x1"), F.floor(fx.u("b", "event_id") * 100).cast("int").alias("x2"), F.lit(0).alias("low"), F.lit(100).alias("high"))
    return bx.span_filter(e).select("event_id", "x1", "x2")


@query("s16_content_hash", "select doc_id, sha256(text) as sha256 from documents")
def s16(s, d):
    return fx.table(s, d, "documents").select("doc_id", tx.content_sha256(F.col("text")).alias("sha256"))


@query("s17_row_id", "select doc_id, md5(doc_id || ':' || source) as id from documents")
def s17(s, d):
    return fx.table(s, d, "documents").select("doc_id", tx.row_id(F.col("doc_id"), F.col("source")).alias("id"))


@query("s18_calc_windows", f"with {fx.WINDOWS} select * from windows")
def s18(s, d):
    return flat(flat(tiles.calc_windows(fx.page_sizes(s, d)), "box"), "cover", "c")


@query("s19_lr_ramp", "select run_id, i::int as i, round(1e-7::double * pow(1e7::double, case when n > 1 then i / (n - 1)::double else 0 end), 12) as lr from (select run_id, n, unnest(range(n)) as i from (select user_id as run_id, count(*) as n from events group by user_id))")
def s19(s, d):
    """A ramp as long as each run."""
    runs = fx.run_log(s, d).groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.select("run_id", F.posexplode(runlog.lr_ramp(1e-7, 1.0, F.col("n"))).alias("i", "lr")).withColumn("lr", F.round("lr", 12))


@query("j1_covered_detections", D + "select page_id, window_id, det_seq, trunc(py1)::int as y1, trunc(px1)::int as x1, trunc(py2)::int as y2, trunc(px2)::int as x2, round(confidence, 9) as confidence, value from covered")
def j1(s, d):
    out = tiles.covered_detections(fx.detections(s, d), tiles.calc_windows(fx.page_sizes(s, d)))
    return flat(out, "page_box").withColumn("confidence", F.round("confidence", 9))


@query("l1_order_matches", D + "select page_id, window_id, det_seq, row_number() over (partition by page_id order by confidence, window_id, det_seq) - 1 as seq from covered")
def l1(s, d):
    out = tiles.covered_detections(fx.detections(s, d), tiles.calc_windows(fx.page_sizes(s, d)))
    return tiles.order_matches(out).select("page_id", "window_id", "det_seq", "seq")


# ------------------------------------------------------------ lines and blocks


def _six(c: str):
    """A share rounded to six digits as DuckDB does it, by doubles; F.round makes a decimal of each."""
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


LINES = M + """, g as (select *, sum(new) over (partition by page_id, y1 order by x1 rows unbounded preceding) as part from
  (select *, case when x1 - lag(x2) over (partition by page_id, y1 order by x1) <= 10 then 0 else 1 end as new from matches))
select page_id, y1, min(x1) as x1, y2, max(x2) as x2, round(avg(confidence), 6) as confidence, count(*) as n, string_agg(value, ' ' order by x1) as value from g group by page_id, y1, y2, part"""


@query("g1_a5_stitch_lines", LINES)
def g1(s, d):
    return stitch.lines_of(fx.matches(s, d), fx.bounds(s, d)).select("page_id", "y1", "x1", "y2", "x2", _six("confidence"), "n", "value")


@query("g2_l2_stitch_blocks", f"""with {fx.TOKENS}, l as (select page_id, pos // 8 as line, string_agg(value, ' ' order by pos) as value from tokens group by page_id, pos // 8),
c as (select *, {fx.us('l', 'page_id', 'line')} as confidence from l)
select page_id, min(line * 28 + line // 4 * 32) as y1, 0 as x1, max(line * 28 + line // 4 * 32) + 20 as y2, 480 as x2, round(avg(confidence), 6) as confidence, count(*) as n, string_agg(value, chr(10) order by line) as value from c group by page_id, line // 4""")
def g2(s, d):
    return stitch.blocks_of(fx.regular_lines(s, d), fx.bounds(s, d)).select("page_id", "y1", "x1", "y2", "x2", _six("confidence"), "n", "value")


@query("a6_matches_per_page", M + "select page_id, count(*) as n_matches from matches group by page_id")
def a6(s, d):
    return stitch.matches_per_page(fx.matches(s, d))


@query("ocr_page_blocks")
def ocr_blocks(s, d):
    """The whole flow: windows, detections, cover, order, lines, blocks.  SQL can't say it; tests compare it with loops."""
    return ocr.page_blocks(fx.detections(s, d), tiles.calc_windows(fx.page_sizes(s, d)), 0.25)


_HALF = "sizes as (select page_id, 'f' || page_id as filename, trunc(w * 0.5::double)::int as w, trunc(h * 0.5::double)::int as h from (select page_id, (200 + (page_id * 137) % 5000)::int as w, (200 + (page_id * 311) % 9000)::int as h from pages))"


@query("ocr_page_exports", f"with {fx.DETECTIONS.replace(fx.SIZES, _HALF)}, o as (select *, row_number() over (partition by page_id order by confidence, window_id, det_seq) as line from covered where confidence >= 0.25) select 'f' || page_id as filename, line, value, trunc(py1)::int as y1, trunc(px2)::int as x2 from o")
def ocr_exports(s, d):
    """The whole flow to files: pages at half their size, windows, what is found in them, order, and a line for each match."""
    pages = fx.page_sizes(s, d).withColumns({"sha256": F.sha2("filename", 256), "place": F.col("page_id")})
    lines = ocr.page_exports(pages, fx.detections(s, d, ocr.page_windows(pages, 0.5)), 0.5, 0.25).filter(F.col("json").startswith('{"id"'))
    said = F.from_json(F.rtrim(F.col("json"), F.lit(",")), "id string, bbox array<int>, confidence double, value string").alias("m")
    return lines.select("filename", "line", said).select("filename", "line", "m.value", F.col("m.bbox")[0].alias("y1"), F.col("m.bbox")[3].alias("x2"))


# ------------------------------------------------------------ label tables

L = f"with {fx.LABELS}, files as (select distinct id as name from labels_ where doc_id % 7 <> 0), old as (select * from labels_ where doc_id % 10 <> 0) "


@query("j2_drop_missing", L + "select doc_id, id from old where id in (select name from files)")
def j2(s, d):
    return labels.drop_missing(fx.old_labels(s, d), fx.image_files(s, d))[0].select("doc_id", "id")


@query("j2_missing_report", L + "select count(*) filter (where id not in (select name from files)) as missing, count(*) as total from old")
def j2r(s, d):
    return labels.drop_missing(fx.old_labels(s, d), fx.image_files(s, d))[1]


@query("j3_import_labels", L + "select id from old union all select distinct id from labels_ where id not in (select id from old) and id in (select name from files)")
def j3(s, d):
    return labels.import_labels(fx.old_labels(s, d).select("id", "data"), fx.labels(s, d).select("id", "data"), fx.image_files(s, d)).select("id")


ORDERED = "select doc_id, id, row_number() over (order by md5({seed} || ':' || doc_id), doc_id) as rn, count(*) over () as n from "


@query("w2_split_labels", L + "select doc_id, case when rn <= trunc((1 - 0.1::double) * n) then 'train' else 'val' end as split from (" + ORDERED.format(seed="'7'") + "labels_)")
def w2(s, d):
    return prefix.split_labels(fx.labels(s, d).select("doc_id"), 0.1, "7", "doc_id")


@query("w3_assign_batches", L + "select doc_id, (rn - 1) // 32 as batch from (" + ORDERED.format(seed="'3'") + "labels_) where (rn - 1) // 32 < n // 32")
def w3(s, d):
    return prefix.assign_batches(fx.labels(s, d).select("doc_id"), 32, True, True, "3", "doc_id")


@query("j4_sticky_split", L + "select doc_id, case when doc_id % 4 = 0 then 'val' else 'train' end as split from labels_ where doc_id % 2 = 0 union all select doc_id, case when rn <= trunc((1 - 0.1::double) * n) then 'train' else 'val' end from (" + ORDERED.format(seed="'0'") + "labels_ where doc_id % 2 <> 0)")
def j4(s, d):
    now = fx.labels(s, d).select("doc_id")
    old = now.filter("doc_id % 2 = 0").withColumn("split", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    gone = now.select((F.col("doc_id") + 10**9).alias("doc_id"), F.lit("train").alias("split"))
    return prefix.sticky_split(now, old.union(gone), key="doc_id")


@query("a10_fingerprint", L + "select count(*) as n, sum(('0x' || substr(md5(doc_id || '|' || id), 1, 8))::bigint)::bigint as total from labels_")
def a10(s, d):
    return labels.dataset_fingerprint(fx.labels(s, d).select("doc_id", "id"))


@query("a11_dedupe_labels", L + "select id, min(doc_id) as doc_id from labels_ group by id")
def a11(s, d):
    return labels.dedupe_labels(fx.labels(s, d).select("id", "doc_id", "data"), ["doc_id"]).select("id", "doc_id")


@query("io6_read_det_labels", L + "select id || '.png' as file, w, 600 as h, id as img_hash, 1 as n_polygons from labels_")
def io6(s, d):
    out = src.read_det_labels(fx.labels(s, d))
    return out.select("file", F.col("label.img_dimensions")[0].alias("w"), F.col("label.img_dimensions")[1].alias("h"), "label.img_hash", F.size("label.polygons").alias("n_polygons"))


@query("io6_read_reco_labels", f"with {fx.TOKENS} select md5(page_id || ':' || pos) || '.png' as file, value as label from tokens")
def io6r(s, d):
    return src.read_reco_labels(fx.tokens(s, d).select(tx.row_id(F.col("page_id"), F.col("pos")).alias("id"), F.col("value").alias("label")))


@query("io7_write_split", ORACLES["w2_split_labels"])
def io7(s, d):
    path = _folder(s, "split")
    src.write_split(w2(s, d), path)
    return s.read.schema("doc_id long, split string").parquet(path)


@query("l3_take_samples", "select doc_id, source from documents where n_chars > 500 order by doc_id limit 100")
def l3(s, d):
    return prefix.take_samples(fx.table(s, d, "documents").withColumn("result", F.when(F.col("n_chars") > 500, F.col("source"))), 100, "doc_id").select("doc_id", "source")


@query("l4_limit_items", "select doc_id from documents order by lang, doc_id limit 200")
def l4(s, d):
    return prefix.limit_items(fx.table(s, d, "documents").select("doc_id", "lang"), 200, ["lang", "doc_id"]).select("doc_id")


# ------------------------------------------------------------ scores and logs

I = f"with {fx.IOU} "


@query("j8_iou_pairs", I + "select image_id, class, gt_id, pred_id, round(iou, 9) as iou from pairs")
def j8(s, d):
    return score.iou_pairs(fx.boxes_gt(s, d), fx.boxes_pred(s, d)).withColumn("iou", F.round("iou", 9))


CHOSEN = ", chosen as (select * from (select *, row_number() over (partition by image_id, class, gt_id order by iou desc) as k from pairs) where k = 1)"


@query("g5_pair_boxes", I + CHOSEN + " select image_id, class, gt_id, pred_id, round(iou, 9) as iou from chosen")
def g5(s, d):
    """Two predictions compete for a box; the larger overlap wins."""
    return score.pair_boxes(score.iou_pairs(fx.boxes_gt(s, d), fx.boxes_pred(s, d))).withColumn("iou", F.round("iou", 9))


@query("g5_pair_chains")
def g5_chains(s, d):
    """Predictions that lie between two boxes: the best pairing of a whole row counts, and SQL can't say it."""
    gt = fx.boxes_gt(s, d).withColumns({c: F.col(c) / 2 for c in ("x1", "x2")})  # boxes of 20 on a grid of 40
    return score.pair_boxes(score.iou_pairs(gt, fx.boxes_between(s, d))).withColumn("iou", F.round("iou", 9))


@query("a7_localization", I + CHOSEN + """, b as (select pred_id, max(iou) as best from pairs group by pred_id)
select (select count(*) from gt) as n_gt, (select count(*) from pred) as n_pred, m as matches, round(m / n1, 9) as recall, round(m / n2, 9) as precision, round(b / n2, 9) as mean_iou from
(select count(*) filter (where iou >= 0.5) as m, (select count(*) from gt)::double as n1, (select count(*) from pred)::double as n2, (select sum(best) from b) as b from chosen)""")
def a7(s, d):
    out = score.localization_metrics(fx.boxes_gt(s, d), fx.boxes_pred(s, d))
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision", "mean_iou")})


# Accented letters of the given texts and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


@query("a8_text_match", f"""with {fx.TOKENS}, p as (select value as target, case when {fx.us('t', 'page_id', 'pos')} < 0.5 then value when {fx.us('t', 'page_id', 'pos')} < 0.7 then upper(translate(value, 'ß', 's'))
  when {fx.us('t', 'page_id', 'pos')} < 0.9 then substr(value, 1, 2) else translate(value, 'éèüö', 'eeuo') end as pred from tokens)
select count(*) as n, round(avg((target = pred)::int), 9) as raw, round(avg((translate(lower(target), '{ACCENTED}', '{PLAIN}') = translate(lower(pred), '{ACCENTED}', '{PLAIN}'))::int), 9) as unicase from p""")
def a8(s, d):
    return score.text_match(fx.text_pairs(s, d)).withColumns({c: F.round(c, 9) for c in ("raw", "unicase")})


# The words in three scripts, letter for letter, and how these letters are written in plain ones.
_CYRILLIC = {"a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "x": "ж", "z": "з", "i": "и", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "h": "х", "c": "ц", "q": "ч", "w": "ш", "j": "щ", "y": "ы", "e": "э"}
_CYRILLIC_PLAIN = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y"}
_HANGUL = {"a": "가", "b": "난", "c": "덕", "d": "롬", "e": "불", "f": "샵", "g": "엥", "h": "좋", "i": "책", "k": "퀴", "l": "튼", "m": "픽", "n": "흙", "o": "까", "p": "띄", "r": "빵", "s": "쏘", "t": "쪽", "u": "워"}
_HANGUL_PLAIN = {"가": "ga", "난": "nan", "덕": "deog", "롬": "rom", "불": "bul", "샵": "syab", "엥": "eng", "좋": "joh", "책": "caeg", "퀴": "kwi", "튼": "teun", "픽": "pig", "흙": "heulg", "까": "gga", "띄": "ddyi", "빵": "bbang", "쏘": "sso", "쪽": "jjog", "워": "weo"}
_CYRILLIC_PLAIN = {c: _CYRILLIC_PLAIN.get(c, k) for k, c in _CYRILLIC.items()}


def _replaced(text: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        text = f"replace({text}, '{a}', '{b}')"
    return text


_SCRIPTED = f"""case page_id % 3 when 0 then replace(lower(value), 'ss', 'ß') when 1 then translate(lower(value), '{''.join(_CYRILLIC)}', '{''.join(_CYRILLIC.values())}')
  else translate(lower(value), '{''.join(_HANGUL)}', '{''.join(_HANGUL.values())}') end"""
_PLAINED = _replaced(_replaced(_replaced("{0}", {"ß": "ss"}), _CYRILLIC_PLAIN), _HANGUL_PLAIN)


@query("a8_unicase_scripts", f"""with {fx.TOKENS}, s as (select *, {_SCRIPTED} as target, {fx.us('t', 'page_id', 'pos')} as r from tokens),
p as (select page_id, target, case when r < 0.4 then target when r < 0.6 then upper(replace(target, 'ß', 'ss')) when r < 0.8 then {_PLAINED.format('target')} else substr(target, 1, 2) end as pred from s),
f as (select page_id, target, pred, translate({_PLAINED.format('lower(target)')}, '{ACCENTED}', '{PLAIN}') as ft, translate({_PLAINED.format('lower(pred)')}, '{ACCENTED}', '{PLAIN}') as fp from p)
select ['german', 'cyrillic', 'hangul'][page_id % 3 + 1] as script, count(*) as n, round(avg((target = pred)::int), 9) as raw, round(avg((ft = fp)::int), 9) as unicase from f group by 1""")
def a8_scripts(s, d):
    """Words with sharp s, in Cyrillic and in Hangul, read right, in capitals, in plain letters, or cut."""
    t = fx.tokens(s, d).withColumns({"target": F.expr(_SCRIPTED), "r": fx.u("t", "page_id", "pos")})
    r = F.col("r")
    pred = F.when(r < 0.4, F.col("target")).when(r < 0.6, F.upper(F.replace("target", F.lit("ß"), F.lit("ss")))).when(r < 0.8, F.expr(_PLAINED.format("target"))).otherwise(F.substring("target", 1, 2))
    script = F.element_at(F.array(F.lit("german"), F.lit("cyrillic"), F.lit("hangul")), (F.col("page_id") % 3 + 1).cast("int"))
    return score.text_match(t.select(script.alias("script"), "target", pred.alias("pred")), ("script",)).withColumns({c: F.round(c, 9) for c in ("raw", "unicase")})


@query("a9_mean_loss", "select round(avg(value), 6) as mean_loss from events")
def a9(s, d):
    return score.mean_loss(fx.table(s, d, "events"), "value").withColumn("mean_loss", F.round("mean_loss", 6))


G = f"with {fx.LOG} "
PREV = "min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding)"
SMOOTH = G + ", sm as (select run_id, epoch, 0.05 * pow(0.95::double, epoch) * sum(val_loss * pow(0.95::double, -epoch)) over (partition by run_id order by epoch rows unbounded preceding) / (1 - pow(0.95::double, epoch + 1)) as smoothed, count(*) over (partition by run_id) as n from log) "


@query("w4_best_checkpoints", G + f"select run_id, epoch, val_loss from (select *, {PREV} as p from log) where p is null or val_loss < p")
def w4(s, d):
    return runlog.best_checkpoints(fx.run_log(s, d))


@query("w5_early_stop", G + f""", m as (select *, {PREV} as best from log), n as (select *, sum((best is null or val_loss < best)::int) over (partition by run_id order by epoch rows unbounded preceding) as part,
  (best is not null and val_loss >= best and val_loss > best + 0.01)::int as bad from m), c as (select *, sum(bad) over (partition by run_id, part order by epoch rows unbounded preceding) as k from n)
select run_id, min(epoch) filter (where bad = 1 and k >= 5) as stop_epoch from c group by run_id""")
def w5(s, d):
    return runlog.early_stop(fx.run_log(s, d))


@query("w6_rolling_loss", G + "select run_id, epoch, round(avg(val_loss) over (partition by run_id order by epoch rows between 19 preceding and current row), 6) as rolling from log")
def w6(s, d):
    return runlog.rolling_loss(fx.run_log(s, d), 2000).select("run_id", "epoch", F.round("rolling", 6).alias("rolling"))


@query("w7_smoothed_loss", SMOOTH + "select run_id, epoch, round(smoothed, 6) as smoothed from sm")
def w7(s, d):
    return runlog.smoothed_loss(fx.run_log(s, d)).select("run_id", "epoch", F.round("smoothed", 6).alias("smoothed"))


@query("w8_lr_curve", SMOOTH + """, cut as (select * from sm where epoch >= least(n // 10, 10) and epoch < n - (case when n >= 20 then least(n // 20, 5) else 0 end)),
low as (select run_id, min(smoothed) as lowest, arg_min(epoch, smoothed) as best_epoch from cut group by run_id)
select cut.run_id, any_value(best_epoch) as best_epoch, round(any_value(lowest), 6) as lowest, round(max(smoothed) filter (where epoch <= best_epoch), 6) as peak from cut join low on cut.run_id = low.run_id group by cut.run_id""")
def w8(s, d):
    return runlog.lr_curve_summary(fx.run_log(s, d)).withColumns({c: F.round(c, 6) for c in ("lowest", "peak")})


# ------------------------------------------------------------ page plans

SEED = "plan"
FONTS = ["a.otf", "b.otf", "c.ttf"]


def _pages(s, d):
    return pg.plan_pages(fx.table(s, d, "pages"), SEED)


def _panels(s, d):
    return pg.plan_panels(_pages(s, d), SEED)


def _bubbles(s, d):
    return pg.plan_bubbles(_panels(s, d), FONTS, SEED)


def _texts(s, d):
    return pg.plan_texts(storage.materialise(_bubbles(s, d)), vocab.cap_frequency(fx.vocab(s, d)), SEED)


_P = ", ".join(f"floor({fx.us(f'{SEED}:{m}', 'page_id')} * 181)::int as \"{m}\"" for m in ("left", "right", "top", "bottom"))


@query("p1_plan_pages", f"""with p as (select page_id, (3 + floor({fx.us(f'{SEED}:rows', 'page_id')} * 10))::int as n_rows, (3 + floor({fx.us(f'{SEED}:cols', 'page_id')} * 10))::int as n_cols, {_P} from pages)
select *, "left" + "right" + n_cols * 120 as w, top + bottom + n_rows * 120 as h from p""")
def p1(s, d):
    return _pages(s, d)


@query("p2_g4_plan_panels")
def p2(s, d):
    return _panels(s, d)


@query("p3_g3_plan_bubbles")
def p3(s, d):
    return _bubbles(s, d)


@query("p4_star_polygons")
def p4(s, d):
    b = _bubbles(s, d)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return b.select("page_id", "panel_id", "bubble_id", F.to_json(pg.star_polygon(F.col("x1"), F.col("y1"), w, h, F.concat_ws(":", "page_id", "panel_id", "bubble_id"))).alias("polygon"))


@query("p5_plan_texts")
def p5(s, d):
    return _texts(s, d)


@query("p6_plan_styles")
def p6(s, d):
    return pg.plan_styles(fx.table(s, d, "pages"), ["1.png", "2.png"], SEED)


@query("p7_detection_labels")
def p7(s, d):
    return pg.detection_labels(_pages(s, d), _texts(s, d))


@query("p7_recognition_labels")
def p7r(s, d):
    out = pg.recognition_labels(_pages(s, d), _texts(s, d))
    return flat(out, "crop")


@query("j5_nest_layout")
def j5(s, d):
    t = storage.materialise(_texts(s, d))
    b = t.select("page_id", "panel_id", "bubble_id").distinct()
    out = labels.nest_layout(_pages(s, d).select("page_id", "w", "h"), b.select("page_id", "panel_id").distinct(), b, t.select("page_id", "panel_id", "bubble_id", "text_id", "word"))
    return out.select("page_id", "w", "h", F.to_json("panels").alias("panels"))


def _greedy(s, d):
    """Boxes of 40 anywhere on a page of 300, in the order of their events."""
    e = fx.table(s, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("box_id"), F.floor(260 * fx.u("gx", "event_id")).cast("int").alias("x1"), F.floor(260 * fx.u("gy", "event_id")).cast("int").alias("y1"))
    return e.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})


@query("g3_keep_first", f"""with b as (select user_id as image_id, event_id, floor(260 * {fx.us('gx', 'event_id')})::int as x, floor(260 * {fx.us('gy', 'event_id')})::int as y from events),
l as (select image_id, list([{{'id': event_id, 'x': x, 'y': y}}] order by event_id) as bs from b group by image_id)
select image_id, k.id as box_id from (select image_id, unnest(list_reduce(bs, lambda a, n: case when len(list_filter(a, lambda o: o.x < n[1].x + 40 and n[1].x < o.x + 40 and o.y < n[1].y + 40 and n[1].y < o.y + 40)) = 0 then list_concat(a, n) else a end)) as k from l)""")
def g3(s, d):
    return stitch.keep_first_disjoint(_greedy(s, d), ["image_id"], "box_id").select("image_id", "box_id")


@query("g4_pack_rects", f"""with p as (select page_id, (3 + page_id % 6)::int as nr, (3 + page_id % 5)::int as nc from pages),
t as (select page_id, nr, nc, unnest(range(12))::int as t from p),
z as (select page_id, nr, nc, t, (1 + floor(3 * {fx.us('rw', 'page_id', 't')}))::int as w, (1 + floor(3 * {fx.us('rh', 'page_id', 't')}))::int as h from t),
l as (select page_id, list_concat([[{{'t': -1, 'w': 0, 'h': 0, 'x': 0, 'y': 0, 'nr': 0, 'nc': 0}}]], list([{{'t': t, 'w': w, 'h': h, 'x': 0, 'y': 0, 'nr': nr, 'nc': nc}}] order by t)) as rs from z group by page_id),
o as (select page_id, unnest(list_reduce(rs, lambda a, n: list_concat(a, list_transform(
  list_filter(flatten(list_transform(range(least(n[1].nr, n[1].nc - n[1].w + 1)), lambda x: list_transform(range(least(n[1].nc, n[1].nr - n[1].h + 1)), lambda y: {{'x': x::int, 'y': y::int}}))),
    lambda c: len(list_filter(a, lambda k: k.x < c.x + n[1].w and c.x < k.x + k.w and k.y < c.y + n[1].h and c.y < k.y + k.h)) = 0)[1:1],
  lambda c: {{'t': n[1].t, 'w': n[1].w, 'h': n[1].h, 'x': c.x, 'y': c.y, 'nr': n[1].nr, 'nc': n[1].nc}})))) as k from l)
select page_id, k.t as try_id, k.w as w, k.h as h, k.x as x, k.y as y from o where k.t >= 0""")
def g4(s, d):
    p = F.col("page_id")
    t = fx.table(s, d, "pages").select("page_id", (3 + p % 6).cast("int").alias("n_rows"), (3 + p % 5).cast("int").alias("n_cols"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("try_id"))
    size = lambda k: (1 + F.floor(3 * fx.u(k, "page_id", "try_id"))).cast("int")
    return stitch.pack_rects(t.withColumns({"w": size("rw"), "h": size("rh")})).select("page_id", "try_id", "w", "h", "x", "y")


@query("j5_nest_words", f"with {fx.TOKENS} select d.doc_id as page_id, coalesce(n_panels, 0)::int as n_panels, coalesce(n_bubbles, 0)::bigint as n_bubbles, coalesce(words, '') as words from documents d left join (select page_id, count(distinct pos // 64) as n_panels, count(distinct pos // 16) as n_bubbles, string_agg(value, ' ' order by pos) as words from tokens group by page_id) t on d.doc_id = t.page_id")
def j5_words(s, d):
    """The words of a text as panels of 64 and bubbles of 16, nested and read out again in order."""
    t = fx.tokens(s, d).select("page_id", F.floor(F.col("pos") / 64).cast("int").alias("panel_id"), F.floor(F.col("pos") / 16).cast("int").alias("bubble_id"), F.col("pos").alias("text_id"), F.col("value").alias("word"))
    b = t.select("page_id", "panel_id", "bubble_id").distinct()
    pages = fx.table(s, d, "documents").select(F.col("doc_id").alias("page_id"))
    out = labels.nest_layout(pages, b.select("page_id", "panel_id").distinct(), b, t)
    bubbles = F.flatten(F.transform("panels", lambda p: p["bubbles"]))
    words = F.transform(F.flatten(F.transform(bubbles, lambda b: b["texts"])), lambda x: x["word"])
    return out.select("page_id", F.size("panels").alias("n_panels"), F.size(bubbles).cast("long").alias("n_bubbles"), F.array_join(words, " ").alias("words"))


@query("j9_collisions", M + "select a.page_id, a.seq as a, b.seq as b from matches a join matches b on a.page_id = b.page_id and a.y1 = b.y1 and a.seq < b.seq and a.x1 < b.x2 and b.x1 < a.x2 + 30 where a.x1 < b.x2 + 30 union all select page_id, seq, null from matches where x2 + 30 > 470 or y2 > 900")
def j9(s, d):
    m = fx.matches(s, d).select("page_id", F.col("seq").alias("box_id"), "y1", "x1", "y2", (F.col("x2") + 30).alias("x2"), F.lit(900).alias("n_rows"), F.lit(470).alias("n_cols"))
    return score.collisions(m, fx.bounds(s, d))


# ------------------------------------------------------------ exports, pixels, streams


@query("io3_catalog", "select 'f' || k as name, max(page_id || '/' || url) filter (where page_id = last) as path from (select *, max(page_id) over (partition by k) as last from (select *, page_id - page_id % 3 // 2 as k from pages)) group by k")
def io3(s, d):
    files = fx.table(s, d, "pages").select(F.concat(F.lit("f"), (F.col("page_id") - F.floor(F.col("page_id") % 3 / 2)).cast("string")).alias("name"), F.concat_ws("/", "page_id", "url").alias("path"), "page_id")
    return src.catalog_by_basename(files, [F.col("page_id")])


@query("io8_export_pages", M + ", p as (select 'f' || (doc_id - doc_id % 3 // 2) as filename, max(doc_id) as page_id from documents group by 1) select filename, (select count(*) from matches m where m.page_id = p.page_id) as n, (select value from matches m where m.page_id = p.page_id order by confidence, seq limit 1) as first_value from p")
def io8(s, d):
    docs = fx.table(s, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("f"), (F.col("doc_id") - F.floor(F.col("doc_id") % 3 / 2)).cast("string")).alias("filename"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("place"))
    out = src.export_pages(pages, fx.matches(s, d), fx.bounds(s, d))
    parsed = F.from_json("json", "filename string, sha256 string, matches array<struct<id:string,bbox:array<int>,confidence:double,value:string>>")
    return out.select("filename", parsed.alias("p")).select("filename", F.size("p.matches").cast("long").alias("n"), F.try_element_at("p.matches", F.lit(1))["value"].alias("first_value"))


@query("io8_export_lines", M + f", p as (select 'f' || (doc_id - doc_id % 3 // 2) as filename, max(doc_id) as page_id from documents group by 1) select filename, row_number() over (partition by m.page_id order by confidence, seq) as line, md5(m.page_id || ':' || seq) as id, value, x2 from matches m join p on m.page_id = p.page_id")
def io8_lines(s, d):
    """What the lines of each page's file say of its matches, in order."""
    docs = fx.table(s, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("f"), (F.col("doc_id") - F.floor(F.col("doc_id") % 3 / 2)).cast("string")).alias("filename"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("place"))
    lines = src.export_lines(pages, fx.matches(s, d), fx.bounds(s, d)).filter(F.col("json").startswith('{"id"'))
    said = F.from_json(F.rtrim(F.col("json"), F.lit(",")), "id string, bbox array<int>, confidence double, value string").alias("m")
    return lines.select("filename", "line", said).select("filename", "line", "m.id", "m.value", F.col("m.bbox")[3].alias("x2"))


# What a page's file is called, and whether it is listed as an image.
_NAMES = ["a{k}.png", "b{k}.jpg", "C{k}.PNG", "d{k}.jpeg", "e{k}.txt", "same.png", "deep/f{k}.png", "deep/er/g{k}.jpg"]


@query("io2_list_images", "with p as (select page_id, 'd' || page_id % 40 || '/' || replace(['" + "', '".join(_NAMES) + "'][page_id % 8 + 1], '{k}', page_id::varchar) as path, length(encode(coalesce(html, ''))) as size from (select page_id, html from pages)), q as (select path, split_part(path, '/', -1) as name, arg_max(size, page_id) as size from p group by path) select path, name, size::bigint as size, row_number() over (order by name, path) as place from q where path like '%.png' or path like '%.jpg'".replace("length(encode", "octet_length(encode"))
def io2(s, d):
    """Pages written as files of several kinds in nested folders, then listed by name."""
    folder = _folder(s, "images")
    k = F.col("page_id")
    pattern = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 8 + 1).cast("int"))
    path = F.concat(F.lit("d"), (k % 40).cast("string"), F.lit("/"), F.replace(pattern, F.lit("{k}"), k.cast("string")))
    files = fx.table(s, d, "pages").select(path.alias("path"), F.struct("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")).alias("f"))
    src.write_files(files.groupBy("path").agg(F.max_by("f.content", "f.page_id").alias("content")), folder)
    found = storage.materialise(src.list_images(s, folder))
    at = F.length(F.lit(f"{images.plain_path(folder)}/"))
    return prefix.row_numbers(found.withColumn("path", F.substr("path", at + 1)), ["name", "path"], "place")


@query("io9_dump_json", "select page_id, null::varchar as secret, url, true as has_null from pages")
def io9(s, d):
    p = fx.table(s, d, "pages")
    rec = p.select("page_id", F.struct(F.col("url"), F.lit("x").alias("secret"), F.lit(None).cast("int").alias("fill")).alias("info"), F.create_map(F.lit("secret"), F.lit(1), F.lit("kept"), F.lit(2)).alias("m"))
    j = src.dump_json(rec, ("secret",)).select(F.col("json"), F.from_json("json", "page_id long, info struct<url:string,secret:string>, m map<string,int>").alias("r"))
    return j.select("r.page_id", F.coalesce(F.col("r.info.secret"), F.element_at("r.m", "secret").cast("string")).alias("secret"), "r.info.url", F.col("json").contains('"fill":null').alias("has_null"))


_WIDE = 16  # pixels in a row, of three bytes each


@query("g6_crop_pixels", f"""with p as (select page_id, hex(encode(coalesce(html, ''))) as h, (octet_length(encode(coalesce(html, ''))) + {3 * _WIDE - 1}) // {3 * _WIDE} as tall from pages),
b as (select page_id, h, tall, k as box_id, (page_id * 7 + k * 11) % (tall + 4) - 2 as y1, (page_id * 3 + k * 5) % {_WIDE + 4} - 2 as x1, 3 + k as height, 4 + k as width from (select *, unnest(range(3)) as k from p)),
r as (select page_id, box_id, height, width, y, case when y < 0 or y >= tall then '' else repeat('00', (3 * greatest(0, -x1))::bigint)
  || substr(rpad(h, (tall * {6 * _WIDE})::int, '0'), (y * {6 * _WIDE} + 6 * greatest(0, x1) + 1)::bigint, (6 * greatest(0, least({_WIDE}, x1 + width) - greatest(0, x1)))::bigint) end as part
  from (select *, unnest(range(y1, y1 + height)) as y from b))
select page_id, box_id, any_value(height)::int as height, any_value(width)::int as width, md5(string_agg(rpad(part, (6 * width)::int, '0'), '' order by y)) as pixels from r group by page_id, box_id""")
def g6(s, d):
    """Images whose pixels are the bytes of whole pages, cropped by three boxes each, which may reach beyond them."""
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    tall = F.floor((F.length(data) + 3 * _WIDE - 1) / (3 * _WIDE)).cast("int")
    pages = fx.table(s, d, "pages").select("page_id", data.alias("b"), tall.alias("tall"))
    full = F.unhex(F.rpad(F.hex("b"), F.col("tall") * 6 * _WIDE, "0"))
    images = pages.select("page_id", F.struct(F.col("tall").alias("height"), F.lit(_WIDE).alias("width"), F.lit(3).alias("nChannels"), full.alias("data")).alias("image"))
    boxes = pages.select("page_id", "tall", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("box_id"))
    y, x = (F.col("page_id") * 7 + F.col("box_id") * 11) % (F.col("tall") + 4) - 2, (F.col("page_id") * 3 + F.col("box_id") * 5) % (_WIDE + 4) - 2
    boxes = boxes.select("page_id", "box_id", *[c.cast("int").alias(n) for n, c in (("y1", y), ("x1", x), ("y2", y + 3 + F.col("box_id")), ("x2", x + 4 + F.col("box_id")))])
    return pixels.crop_pixels(images, boxes).select("page_id", "box_id", "height", "width", F.md5(F.hex("data")).alias("pixels"))


def _counter():
    return lambda pdf: pdf.assign(value=pdf["value"].str.len())[["page_id", "seq", "value"]]


@query("f2_predict_hook", M + "select page_id, seq, length(value) as value from matches")
def f2(s, d):
    return pixels.predict_windows(fx.matches(s, d), _counter, "page_id long, seq int, value long")


@query("t1_stream_vocab", W + "select id, count from vocab")
def t1(s, d):
    schema = fx.table(s, d, "documents").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    path = _folder(s, "vocab")
    st.write_stream_vocab(st.stream_vocab(stream, alphabet=tx.LATIN), path, _folder(s, "stream")).awaitTermination()
    return s.read.schema("id string, count long").parquet(path)


@query("t2_stream_labels", f"with {fx.LABELS} select distinct id from labels_")
def t2(s, d):
    docs = s.readStream.schema(fx.table(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    stream = docs.select(F.sha2("text", 256).alias("id"), F.col("lang").alias("data"))
    path = _folder(s, "labels")
    for _ in range(2):  # the second run replays all and adds nothing
        st.stream_labels(stream, path, _folder(s, "stream")).awaitTermination()
    return s.read.schema("id string, data string").parquet(path).select("id")


def entry(spark, sf_dir: str) -> DataFrame:
    """Words of the documents, counted, raised to their floor and capped."""
    return vocab.cap_frequency(vocab.apply_floor(fx.vocab(spark, sf_dir), hangul=0))
