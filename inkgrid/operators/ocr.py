"""Reading pages as one flow: from sizes to windows, and from what a model found in these to blocks of text and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import resized_dims
from ..sources.tables import export_lines
from .stitch import blocks_of, lines_of
from .tiles import calc_windows, covered_detections, order_matches


def page_matches(detections: DataFrame, windows: DataFrame, min_confidence: float = 0) -> DataFrame:
    """page_id, seq, y1, x1, y2, x2, confidence and value of the detections that their windows cover, in order."""
    found = order_matches(covered_detections(detections, windows, min_confidence))
    return found.select("page_id", "seq", *[F.col(f"page_box.{c}").alias(c) for c in ("y1", "x1", "y2", "x2")], "confidence", "value")


def page_blocks(detections: DataFrame, windows: DataFrame, min_confidence: float = 0) -> DataFrame:
    """page_id, block_seq, box, confidence, n (lines) and value of the blocks of every page."""
    return blocks_of(lines_of(page_matches(detections, windows, min_confidence)))


def page_windows(pages: DataFrame, ratio: float | None = None, crop: int = 1024, margin: int = 100) -> DataFrame:
    """The windows of pages (page_id, w, h) after they are resized by ratio; none, or 0, leaves them as they are."""
    size = resized_dims(F.col("w"), F.col("h"), F.lit(ratio).cast("double"))
    return calc_windows(pages.select("page_id", size.alias("__size")).select("page_id", "__size.w", "__size.h"), crop, margin)


def page_exports(pages: DataFrame, detections: DataFrame, ratio: float | None = None, min_confidence: float = 0, crop: int = 1024, margin: int = 100) -> DataFrame:
    """The lines of each page's JSON file (see export_lines), with the matches of all its windows.

    pages: page_id, filename, sha256, w, h and place (of pages with one file name the last place stays).
    """
    matches = page_matches(detections, page_windows(pages, ratio, crop, margin), min_confidence)
    return export_lines(pages.select("page_id", "filename", "sha256", "place"), matches)
