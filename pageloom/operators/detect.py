"""Form fields on page images: regions, letterbox, an injected detector, its rows as boxes, and whether they are filled.

pages: page, rgba (binary, four bytes a pixel), width, height. The detector takes one picture of (3, 640, 640) floats and
returns rows of eight numbers; the state model takes one crop of (40, 160) floats and returns two. Loaders are called
once in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..models import Loader, ModelError
from . import geometry
from .image import letterbox, state_crop

RAW = "page long, height int, region int, y0 int, y1 int, scale double, box_id long, v array<double>"


def checked(pages: DataFrame) -> DataFrame:
    """pages with error: what is wrong with a picture's size, or null."""
    good = (F.col("width") > 0) & (F.col("height") > 0) & (F.length("rgba") == 4 * F.col("width").cast("long") * F.col("height"))
    return pages.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), F.lit("the picture is not of four bytes a pixel")))


def picture(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def _rows_of(model, image: np.ndarray, scale: float, least: float) -> np.ndarray:
    found = np.asarray(model(image), np.float64).reshape(-1)
    if len(found) % 8:
        raise ModelError("rows are not of eight numbers")
    found = found.reshape(-1, 8)
    return found[found[:, 4] * found[:, 5:].max(axis=1, initial=0) >= least]


def raw_rows(pages: DataFrame, loader: Loader, tiles: bool = True, min_score: float = C.MIN_SCORE) -> DataFrame:
    """The detector's rows of every region of every page that reach the score; see RAW. Broken pictures have none."""
    cuts = geometry.regions(checked(pages).where("error is null").select("page", "height")).select("page", "region", "y0", "y1")
    cuts = cuts if tiles else cuts.where("region = 0")
    listed = cuts.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("region", "y0", "y1"))).alias("cuts"))
    rows = pages.select(F.col("page").cast("long"), "rgba", F.col("width").cast("int"), F.col("height").cast("int")).join(listed, "page")

    def run(batches):
        model = loader()
        for batch in batches:
            for page, rgba, width, height, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for cut in own:
                    image, scale = letterbox(picture(rgba, width, height)[cut["y0"] : cut["y1"]])
                    for i, v in enumerate(_rows_of(model, image, scale, min_score)):
                        out.append((page, height, cut["region"], cut["y0"], cut["y1"], float(scale), cut["region"] * 1_000_000 + i, v.tolist()))
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = (pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RAW.split(", ")])

    return rows.select("page", "rgba", "width", "height", "cuts").mapInArrow(run, RAW)


def merged_rows(raw: DataFrame, min_score: float = C.MIN_SCORE, max_overlap: float = C.MAX_OVERLAP, page_check: bool = True) -> DataFrame:
    """page, box_id, kind, score, l, t, r, b, place of raw rows: reduced in each region, then as one page."""
    boxes = geometry.decoded(raw, F.col("scale")).drop("v", "scale")
    own = geometry.suppressed(boxes, max_overlap, ("page", "region", "kind"))
    whole = geometry.suppressed(geometry.from_regions(own), max_overlap).where(F.col("score") >= min_score)
    kept = geometry.cross_kind(whole)
    kept = geometry.page_check(kept) if page_check else kept
    return geometry.ordered(kept.select("page", "box_id", "kind", "score", *geometry.BOX))


def find_fields(pages: DataFrame, detector: Loader, state: Loader | None = None, tiles: bool = True, min_score: float = C.MIN_SCORE, max_overlap: float = C.MAX_OVERLAP, page_check: bool = True) -> DataFrame:
    """page, box_id, kind, score, l, t, r, b, place and, from the state model, filled (null without one)."""
    found = merged_rows(raw_rows(pages, detector, tiles, min_score), min_score, max_overlap, page_check)
    if state is None:
        return found.withColumn("filled", F.lit(None).cast("boolean"))
    return with_states(found, pages, state)


def with_states(fields: DataFrame, pages: DataFrame, loader: Loader) -> DataFrame:
    """fields with filled: whether the state model takes the field's crop for a filled one. A page's fields travel to its
    picture as one array, so that no picture is copied for each field."""
    boxes = fields.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("box_id", *[F.col(c).cast("double").alias(c) for c in geometry.BOX]))).alias("boxes"))
    rows = pages.select(F.col("page").cast("long"), "rgba", F.col("width").cast("int"), F.col("height").cast("int")).join(boxes, "page")

    def run(batches):
        model = loader()
        for batch in batches:
            out = []
            for page, rgba, width, height, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = picture(rgba, width, height)
                for box in own:
                    logits = model(state_crop(image, tuple(box[c] for c in geometry.BOX)))
                    if len(logits) != 2:
                        raise ModelError(f"{len(logits)} logits instead of 2")
                    out.append((page, box["box_id"], bool(logits[1] > logits[0])))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["page", "box_id", "filled"])

    states = rows.select("page", "rgba", "width", "height", "boxes").mapInArrow(run, "page long, box_id long, filled boolean")
    return fields.join(states, ["page", "box_id"], "left")


def find_prepared(prepared: DataFrame, detector: Loader, min_score: float = C.MIN_SCORE, max_overlap: float = C.MAX_OVERLAP) -> DataFrame:
    """Like find_fields of pages that are letterboxed already: page, rgb (640 x 640, three bytes a pixel) and scale."""

    def run(batches):
        model = loader_of()
        for batch in batches:
            for page, rgb, scale in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rgb is None or len(rgb) != 3 * 640 * 640:
                    raise ModelError("the picture is not of 640 x 640 pixels")
                image = np.frombuffer(rgb, np.uint8).reshape(640, 640, 3).transpose(2, 0, 1).astype(np.float32)
                found = _rows_of(model, image, scale, min_score)
                n = len(found)
                cols = ([page] * n, [640] * n, [0] * n, [0] * n, [640] * n, [float(scale)] * n, list(range(n)), found.tolist())
                kinds = (pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RAW.split(", ")])

    loader_of = detector
    raw = prepared.select(F.col("page").cast("long"), "rgb", F.col("scale").cast("double")).mapInArrow(run, RAW)
    return merged_rows(raw, min_score, max_overlap, page_check=False)
