"""Pixels of boxes, and a hook for a model that reads them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CROP = "page_id long, box_id long, height int, width int, channels int, data binary"
#: Boxes that are cut from one copy of an image.
TOGETHER = 1024


def images_with_boxes(images: DataFrame, boxes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """page_id, image and boxes (an array of about so many): an image moves once for each such array, not for each box.

    A page's boxes are counted and dealt by hash, so a page may have any share of them.  Boxes without an image go.
    """
    many = boxes.groupBy("page_id").agg(F.ceil(F.count("*") / together).alias("__parts"))
    counted = boxes.join(many, "page_id")
    dealt = counted.withColumn("__part", F.pmod(F.xxhash64("box_id", "y1", "x1"), F.col("__parts")))
    listed = dealt.groupBy("page_id", "__part").agg(F.collect_list(F.struct("box_id", "y1", "x1", "y2", "x2")).alias("boxes"))
    copies = images.join(many, "page_id").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    return copies.join(listed, ["page_id", "__part"]).select("page_id", "image", "boxes")


def crop_pixels(images: DataFrame, boxes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The pixels of boxes (page_id, box_id, y1, x1, y2, x2) in images (page_id, image: Spark's image struct); outside the image they are zero."""
    rows = images_with_boxes(images, boxes, together).select("page_id", "image.height", "image.width", "image.nChannels", "image.data", "boxes")

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                page, height, width, channels = (batch.column(c)[k].as_py() for c in range(4))
                whole = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint8).reshape(height, width, channels)
                rows = []
                for box in batch.column(5)[k].as_py():
                    y1, x1, y2, x2 = (box[c] for c in ("y1", "x1", "y2", "x2"))
                    out = np.zeros((max(0, y2 - y1), max(0, x2 - x1), channels), np.uint8)
                    a, b, c, d = max(0, y1), max(0, x1), min(height, y2), min(width, x2)
                    if a < c and b < d:
                        out[a - y1 : c - y1, b - x1 : d - x1] = whole[a:c, b:d]
                    rows.append((page, box["box_id"], *out.shape, out.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["page_id", "box_id", "height", "width", "channels", "data"])

    return rows.mapInArrow(crop, CROP)


def predict_windows(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """What a model says about each batch of rows; make_model is called once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)
