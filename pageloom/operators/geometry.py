"""Boxes on pages: regions, overlap, suppression, blockers, nearest fields, rows and cells. Every join has the page as its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import config as C
from ..functions import folds
from ..functions.runs import fold_runs

BOX = ("l", "t", "r", "b")


def _of(side: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{side}.{c}") for c in BOX)


def intersection(a: str = "x", b: str = "y") -> Column:
    al, at, ar, ab = _of(a)
    bl, bt, br, bb = _of(b)
    return F.greatest(F.lit(0.0), F.least(ar, br) - F.greatest(al, bl)) * F.greatest(F.lit(0.0), F.least(ab, bb) - F.greatest(at, bt))


def area(a: str) -> Column:
    left, top, right, bottom = _of(a)
    return (right - left) * (bottom - top)


def iou(a: str = "x", b: str = "y") -> Column:
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + 1e-9)


def crossing(a: str = "x", b: str = "y") -> Column:
    al, at, ar, ab = _of(a)
    bl, bt, br, bb = _of(b)
    return (al < br) & (bl < ar) & (at < bb) & (bt < ab)


def same_row(a: str = "x", b: str = "y") -> Column:
    _, at, _, ab = _of(a)
    _, bt, _, bb = _of(b)
    return F.least(ab, bb) - F.greatest(at, bt) >= 0.5 * F.greatest(F.least(ab - at, bb - bt), F.lit(0.1))


def overlapping(boxes: DataFrame, least: float = C.MAX_OVERLAP) -> DataFrame:
    """page, a, b, iou of pairs of one kind on one page that overlap by more than least."""
    pairs = boxes.alias("x").join(boxes.alias("y"), (F.col("x.page") == F.col("y.page")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.box_id") < F.col("y.box_id")) & crossing())
    return pairs.select(F.col("x.page").alias("page"), F.col("x.box_id").alias("a"), F.col("y.box_id").alias("b"), iou().alias("iou")).where(F.col("iou") > least)


def cross_kind(boxes: DataFrame) -> DataFrame:
    """boxes that no stronger box of another kind covers by more than half; judged all at once."""
    stronger = (F.col("x.page") == F.col("y.page")) & (F.col("x.kind") != F.col("y.kind")) & (F.col("y.score") > F.col("x.score")) & crossing() & (intersection() > C.COVERED * area("x"))
    return boxes.alias("x").join(boxes.alias("y"), stronger, "left_anti")


def page_check(boxes: DataFrame) -> DataFrame:
    """boxes of the pages with at least three of score 0.3."""
    strong = F.count_if(F.col("score") >= C.CHECK_SCORE).over(Window.partitionBy("page"))
    return boxes.withColumn("strong", strong).where(F.col("strong") >= C.CHECK_COUNT).drop("strong")


def suppressed(boxes: DataFrame, most: float = C.MAX_OVERLAP, keys: tuple[str, ...] = ("page", "kind")) -> DataFrame:
    """boxes kept by greedy suppression within keys, strongest first, then by box_id."""
    at = [boxes.columns.index(c) for c in ("score", *BOX)]

    def fold(rows):
        return [rows[i] for i in folds.nms([tuple(r[i] for i in at) for r in rows], most)]

    return fold_runs(boxes, list(keys), ["box_id"], fold, boxes.schema)


def merged(boxes: DataFrame) -> DataFrame:
    """Detections after suppression, the score threshold and the rule across kinds."""
    return cross_kind(suppressed(boxes).where(F.col("score") >= C.MIN_SCORE))


def decoded(rows: DataFrame, scale: Column) -> DataFrame:
    """kind, score, l, t, r, b of raw detector rows (v: array of 8); the first of equally likely kinds."""
    v = lambda i: F.get("v", F.lit(i))
    p = F.slice("v", 6, 3)
    kind = F.array_position(p, F.array_max(p))
    rows = rows.withColumn("kind", F.element_at(F.array(F.lit("text"), F.lit("choice"), F.lit("signature")), kind.cast("int"))).withColumn("score", v(4) * F.array_max(p))
    return rows.where(F.col("score") >= C.MIN_SCORE).withColumns({"l": (v(0) - v(2) / 2) / scale, "t": (v(1) - v(3) / 2) / scale, "r": (v(0) + v(2) / 2) / scale, "b": (v(1) + v(3) / 2) / scale})


def nearest_above(boxes: DataFrame, h: float) -> DataFrame:
    """box_id, above: the nearest box above in the column (0.7 of the narrower width, gap -0.3 h to 2 h)."""
    gap = F.col("x.t") - F.col("y.b")
    shared = F.least("x.r", "y.r") - F.greatest("x.l", "y.l")
    near = (F.col("x.page") == F.col("y.page")) & (F.col("x.box_id") != F.col("y.box_id")) & gap.between(-0.3 * h, 2 * h) & (shared >= 0.7 * F.least(F.col("x.r") - F.col("x.l"), F.col("y.r") - F.col("y.l")))
    pairs = boxes.alias("x").join(boxes.alias("y"), near).select(F.col("x.box_id").alias("box_id"), gap.alias("gap"), F.col("y.box_id").alias("other"))
    return pairs.groupBy("box_id").agg(F.min(F.struct("gap", "other")).alias("n")).select("box_id", F.col("n.other").alias("above"))


def left_words(fields: DataFrame, words: DataFrame, h: float) -> DataFrame:
    """box_id, word_id of words left of a field on its row, within 15 h, with no other field between."""
    near = (F.col("x.page") == F.col("y.page")) & (F.col("y.r") <= F.col("x.l")) & (F.col("x.l") - F.col("y.r") <= 15 * h) & same_row()
    pairs = fields.alias("x").join(words.alias("y"), near).select(F.col("x.page").alias("page"), F.col("x.box_id").alias("box_id"), F.col("y.word_id").alias("word_id"), F.col("y.r").alias("l"), F.greatest("x.t", "y.t").alias("t"), F.col("x.l").alias("r"), F.least("x.b", "y.b").alias("b"))
    between = (F.col("x.page") == F.col("y.page")) & (F.col("x.box_id") != F.col("y.box_id")) & crossing()
    return pairs.alias("x").join(fields.alias("y"), between, "left_anti").select("box_id", "word_id")


def label_runs(words: DataFrame, h: float) -> DataFrame:
    """words (page, row, l, r, text) with cell: a new one after a gap of more than 1.5 h to the running right edge."""
    w = Window.partitionBy("page", "row").orderBy("l", "word_id")
    edge = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(edge.isNull() | (F.col("l") - edge > C.CELL_GAP * h), 1).otherwise(0)
    return words.withColumn("new", new).withColumn("cell", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def reading_order(words: DataFrame, h: float) -> DataFrame:
    """words with line and place: a new line where the top differs by more than half of h from the word before."""
    w = Window.partitionBy("page").orderBy("t", "l", "word_id")
    new = F.when(F.abs(F.col("t") - F.lag("t").over(w)) > 0.5 * h, 1).otherwise(0)
    rows = words.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("line", "l", "word_id")))


def visual_rows(pieces: DataFrame) -> DataFrame:
    """page, word_id, t, b and row of pieces, by the rule that widens a row with each member."""

    def fold(rows):
        return [(*r, n) for r, n in zip(rows, folds.visual_rows([r[2] for r in rows], [r[3] for r in rows]), strict=True)]

    rows = pieces.select("page", "word_id", "t", "b")
    return fold_runs(rows, ["page"], ["t", "word_id"], fold, StructType([*rows.schema.fields, StructField("row", IntegerType())]))


def upper_median(expression: str) -> Column:
    """The member at n / 2 of the sorted values: an exact rank, without gathering a group's rows."""
    return F.expr(f"percentile_disc(0.5) within group (order by {expression} desc)")


def regions(pages: DataFrame) -> DataFrame:
    """pages (page, height) with region, y0, y1: the whole page, and its halves, each reaching 0.12 into the other."""
    half, h = F.col("height") / 2, F.col("height").cast("int")
    reach = C.TILE_OVERLAP * half
    upper, lower = F.least((half + reach).cast("int"), h), (half - reach).cast("int")
    zero = F.lit(0)
    cuts = [F.struct(F.lit(i).alias("region"), a.alias("y0"), b.alias("y1")) for i, (a, b) in enumerate(((zero, h), (zero, upper), (lower, h)))]
    return pages.select("*", F.inline(F.array(*cuts)))


def from_regions(found: DataFrame) -> DataFrame:
    """Boxes found in regions (height, y0, y1; t and b within the region) as boxes of their page. One that an inner edge
    cuts counts half."""
    cut = ((F.col("y0") > 0) & (F.col("t") < C.EDGE)) | ((F.col("y1") < F.col("height")) & (F.col("b") > F.col("y1") - F.col("y0") - C.EDGE))
    rows = found.withColumn("score", F.when(cut, F.col("score") * C.EDGE_SHARE).otherwise(F.col("score")))
    return rows.withColumns({"t": F.col("t") + F.col("y0"), "b": F.col("b") + F.col("y0")})


KINDS = ("text", "choice", "signature")


def kind_index(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def ordered(boxes: DataFrame) -> DataFrame:
    """boxes with place from 0: by kind, then the strongest first, then by box_id."""
    w = Window.partitionBy("page").orderBy(kind_index(F.col("kind")), F.desc("score"), "box_id")
    return boxes.withColumn("place", F.row_number().over(w) - 1)


def flattened(boxes: DataFrame) -> DataFrame:
    """page and v: seven floats for each box, in order: kind, score, left, top, right, bottom, filled (-1: not known)."""
    filled = F.coalesce(F.col("filled").cast("int"), F.lit(-1))
    row = F.array(*[x.cast("float") for x in (kind_index(F.col("kind")), F.col("score"), *[F.col(c) for c in BOX], filled)])
    lists = ordered(boxes).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", row.alias("v")))).alias("rows"))
    return lists.select("page", F.flatten(F.transform("rows", lambda x: x["v"])).alias("v"))
