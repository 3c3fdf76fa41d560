"""What is printed around form fields, and the label of each: joins of fields and words by page, and windows.

fields: page, box_id, kind ('text' or 'choice'), l, t, r, b. words: page, word_id, text, l, t, r, b, with y downward; of
equals the one of smaller word_id comes first. Everything is keyed by page, so fields, words and what blocks the way
(other fields and box glyphs) are dealt once. h is the page's upper median of word heights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import config as C
from ..functions import text as T
from ..functions.runs import fold_runs
from . import geometry
from .geometry import BOX

PLACES = ("inside", "left", "right", "above", "below")
#: Where a label is looked for, in this order.
ORDER = {"text": ("inside", "caption", "left", "above", "below"), "choice": ("right", "left", "above")}


def split_glyphs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, glyphs): words of box glyphs alone, and the others."""
    return words.where(~T.is_box_glyph(F.col("text"))), words.where(T.is_box_glyph(F.col("text")))


def line_heights(words: DataFrame) -> DataFrame:
    """page, h: the upper median of the heights of words."""
    return words.where("b > t").groupBy("page").agg(geometry.upper_median("b - t").alias("h"))


def blockers(fields: DataFrame, glyphs: DataFrame) -> DataFrame:
    """page, by (the field that it is, null for a glyph), l, t, r, b."""
    box = ["page", *[F.col(c).cast("double").alias(c) for c in BOX]]
    return fields.select(F.col("box_id").alias("by"), *box).unionByName(glyphs.select(F.lit(None).cast("long").alias("by"), *box))


def _own(*extra: str):
    return Window.partitionBy("page", "box_id", "place", *extra)


def _placed(fields: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each field (f_l, f_t, f_r, f_b), place and word that may be read there, with h and, above and below,
    the distance d."""
    own = fields.select("page", "box_id", "kind", *[F.col(c).cast("double").alias(f"f_{c}") for c in BOX])
    own = own.join(line_heights(words), "page", "left").withColumn("h", F.coalesce("h", F.lit(C.DEFAULT_HEIGHT)))
    pairs = own.join(words.select("page", "word_id", "text", *[F.col(c).cast("double").alias(c) for c in BOX]), "page")
    h, x, y = F.col("h"), (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    level = F.least("b", "f_b") - F.greatest("t", "f_t") >= 0.5 * F.greatest(F.least(F.col("b") - F.col("t"), F.col("f_b") - F.col("f_t")), F.lit(0.1))
    column = (F.col("r") > F.col("f_l") - h) & (F.col("l") < F.col("f_r"))
    over, under = F.col("f_t") - F.col("b"), F.col("t") - F.col("f_b")
    none = F.lit(None).cast("double")
    tests = (
        ("inside", (x > F.col("f_l")) & (x < F.col("f_r")) & (y > F.col("f_t")) & (y < F.col("f_t") + 0.5 * (F.col("f_b") - F.col("f_t"))), none),
        ("left", level & (F.col("r") <= F.col("f_l") + 0.5 * h), none),
        ("right", level & (F.col("l") >= F.col("f_r") - 0.5 * h), none),
        ("above", column & over.between(-0.3 * h, 8 * h), over),
        ("below", column & under.between(-0.3 * h, 1.5 * h), under),
    )
    places = F.filter(F.array(*[F.struct(F.lit(p).alias("place"), test.alias("may"), d.alias("d")) for p, test, d in tests]), lambda p: p["may"])
    return pairs.select("*", F.inline(places)).drop("may")


def _first_of_each(rows: DataFrame, flag: str, hit: Column) -> DataFrame:
    """rows that an outer join repeated, each once, with flag: whether any of its repeats is a hit."""
    w = Window.partitionBy("page", "box_id", "place", "word_id").orderBy(F.desc(flag))
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False)).cast("int")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn(flag, F.col(flag) == 1)


def _crossed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (x0, x1, y0, y1) with crossed: whether anything but the row's own field lies in the rectangle."""
    k = blocks.select(F.col("page").alias("k_page"), "by", *[F.col(c).alias(f"k_{c}") for c in BOX])
    hit = (F.col("page") == F.col("k_page")) & (F.col("by").isNull() | (F.col("by") != F.col("box_id"))) & (F.col("k_l") < F.col("x1")) & (F.col("k_r") > F.col("x0")) & (F.col("k_t") < F.col("y1")) & (F.col("k_b") > F.col("y0"))
    met = _first_of_each(rows.join(k, hit, "left"), "crossed", F.col("k_page").isNotNull())
    return met.drop("k_page", "by", *[f"k_{c}" for c in BOX], "x0", "x1", "y0", "y1")


def _outward(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows that nothing keeps a field's label from: beside it, outward on one line up to the first word that is too far,
    behind a blocker or the end of another label, leaders stepped over on the left; above and below, what no blocker
    hides; inside, eight words at most."""
    at, h = F.col("place"), F.col("h")
    left, beside = at == "left", at.isin("left", "right")
    mid, centre = (F.col("f_t") + F.col("f_b")) / 2, (F.col("t") + F.col("b")) / 2
    level = F.min(F.struct(F.abs(centre - mid).alias("d"), "word_id", centre.alias("c"))).over(_own())["c"]
    rows = rows.withColumns({"_line": level, "_many": F.count("*").over(_own())})
    rows = rows.where(F.when(beside, F.abs(centre - F.col("_line")) < 0.5 * h).when(at == "inside", F.col("_many") <= 8).otherwise(True))
    rows = rows.withColumns({"_go": F.when(left, -F.col("l")).otherwise(F.col("l")), "_id": F.when(left, -F.col("word_id")).otherwise(F.col("word_id"))})
    rows = rows.withColumn("_leader", left & T.is_leader(F.col("text")))
    out = _own().orderBy("_go", "_id")
    passed = out.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.coalesce(F.lag(F.when(left, F.col("l")).otherwise(F.col("r"))).over(out), F.when(left, F.col("f_l")).otherwise(F.col("f_r")))
    rows = rows.withColumns({"_edge": edge, "_begun": F.coalesce(F.max((~F.col("_leader")).cast("int")).over(passed), F.lit(0)) > 0})
    above = at == "above"
    by_place = lambda sideways, column: F.when(beside, sideways).when(at != "inside", column)  # noqa: E731  null: no rectangle
    near, far = F.when(left, F.col("r")).otherwise(F.col("_edge")), F.when(left, F.col("_edge")).otherwise(F.col("l"))
    y0, y1 = F.when(above, F.col("b")).otherwise(F.col("f_b")) + 0.1, F.when(above, F.col("f_t")).otherwise(F.col("t")) - 0.1
    box = {"x0": by_place(near, F.greatest("l", "f_l")), "x1": by_place(far, F.least("r", "f_r")), "y0": by_place(mid - 0.1, y0), "y1": by_place(mid + 0.1, y1)}
    rows = _crossed(rows.withColumns(box), blocks)
    limit = F.when(F.col("_begun"), 1.5 * h).when(left, 15.0 * h).otherwise(3.0 * h)
    ends = left & F.col("_begun") & F.col("text").rlike("[:：]\\z")
    stop = F.when(beside, (far - near > limit) | F.col("crossed") | ends).otherwise(False)
    rows = rows.withColumn("_stopped", F.max(stop.cast("int")).over(out.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.when(beside, (F.col("_stopped") == 0) & ~F.col("_leader")).otherwise(~F.col("crossed")))
    return rows.drop("_line", "_many", "_go", "_id", "_leader", "_edge", "_begun", "crossed", "_stopped")


def _nearest_lines(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Above and below only the nearest line, and above also the next one, where both stand within the field's column
    or begin at one edge; the line below is also the caption, if it is small or in brackets."""
    h, column = F.col("h"), F.col("place").isin("above", "below")
    ahead = F.col("d") - F.min("d").over(_own())
    nth = F.when(~column | (ahead < 0.5 * h), 0).when((F.col("place") == "above") & (ahead <= 1.8 * h), 1)
    rows = rows.withColumn("_nth", nth).where("_nth is not null")
    line = _own("_nth")
    rows = rows.withColumns({"_size": F.count("*").over(line), "_edge": F.min("l").over(line), "_head": F.min("word_id").over(line) == F.col("word_id")})
    # a line is local if no word of the page on a row with its first word reaches beyond the field's column
    w = words.select(F.col("page").alias("w_page"), *[F.col(c).cast("double").alias(f"w_{c}") for c in BOX])
    level = F.least("w_b", "b") - F.greatest("w_t", "t") >= 0.5 * F.greatest(F.least(F.col("w_b") - F.col("w_t"), F.col("b") - F.col("t")), F.lit(0.1))
    beyond = (F.col("page") == F.col("w_page")) & F.col("_head") & (F.col("place") == "above") & level & ((F.col("w_l") < F.col("f_l") - h) | (F.col("w_r") > F.col("f_r") + h))
    rows = _first_of_each(rows.join(w, beyond, "left"), "_wide", F.col("w_page").isNotNull()).drop("w_page", *[f"w_{c}" for c in BOX])
    of = lambda n, c: F.max(F.when(F.col("_nth") == n, F.col(c))).over(_own())
    both = ((of(0, "_size") <= 4) & ~F.bool_or("_wide").over(_own())) | (F.abs(of(0, "_edge") - of(1, "_edge")) <= h)
    rows = rows.withColumn("_both", both).where((F.col("_nth") == 0) | F.col("_both")).drop("_size", "_edge", "_head", "_wide", "_both", "_nth", "d")
    small = F.min((F.col("b") - F.col("t") <= 0.85 * h).cast("int")).over(_own()) == 1
    bracket = F.min(F.struct("l", "word_id", F.col("text").startswith("(").alias("x"))).over(_own())["x"]
    as_caption = F.when((F.col("place") == "below") & (small | bracket), F.array(F.lit("below"), F.lit("caption"))).otherwise(F.array("place"))
    return rows.withColumn("_as", as_caption).withColumn("place", F.explode("_as")).drop("_as")


def _read(rows: DataFrame) -> DataFrame:
    """page, box_id, kind, place, text: words in reading order, cleaned; places without a label fall away."""
    own = Window.partitionBy("page", "box_id", "place")
    down = own.orderBy("t", "word_id")
    new = F.when(F.col("t") - F.lag("t").over(down) > 0.5 * F.col("h"), 1).otherwise(0)
    lines = rows.withColumn("new", new).withColumn("line", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    texts = lines.groupBy("page", "box_id", "kind", "place").agg(F.sort_array(F.collect_list(F.struct("line", "l", "t", "word_id", "text"))).alias("ws"))
    label = T.clean_label(F.array_join(F.col("ws.text"), " "))
    return texts.select("page", "box_id", "kind", "place", F.explode(F.array(label)).alias("text")).where("text is not null")


def around(fields: DataFrame, words: DataFrame) -> DataFrame:
    """page, box_id, kind, place, text: every text that stands inside, left, right, above or below of a field, and as
    its caption."""
    plain, glyphs = split_glyphs(words)
    rows = _outward(_placed(fields, plain), blockers(fields, glyphs))
    return _read(_nearest_lines(rows, plain))


def context(fields: DataFrame, words: DataFrame) -> DataFrame:
    """page, box_id, place, text of all places of a field that have text."""
    return around(fields, words).where(F.col("place").isin(*PLACES)).select("page", "box_id", "place", "text")


def own_labels(fields: DataFrame, words: DataFrame) -> DataFrame:
    """fields with label: the text of the first place, in the order of its kind, that has one; else null."""
    places = around(fields, words)
    rank = F.when(F.lit(False), 0)
    for kind, order in ORDER.items():
        for i, place in enumerate(order):
            rank = rank.when((F.col("kind") == kind) & (F.col("place") == place), i)
    best = places.withColumn("rank", rank).where("rank is not null").groupBy("page", "box_id").agg(F.min(F.struct("rank", "text")).alias("x"))
    return fields.join(best.select("page", "box_id", F.col("x.text").alias("label")), ["page", "box_id"], "left")


def field_labels(fields: DataFrame, words: DataFrame) -> DataFrame:
    """page, box_id, kind, l, t, r, b, label: labels of their own, and those handed along combs and down columns."""
    h = line_heights(split_glyphs(words)[0])
    rows = own_labels(fields, words).join(h, "page", "left").withColumn("h", F.coalesce("h", F.lit(C.DEFAULT_HEIGHT)))
    return shared_labels(rows)


def shared_labels(rows: DataFrame) -> DataFrame:
    """page, box_id, kind, l, t, r, b, label of labelled fields (with h), after combs and columns shared their labels."""

    def fold(group):
        found = handed_down([r[2:8] for r in group], group[0][8])
        return [(*r[:7], label) for r, label in zip(group, found, strict=True)]

    rows = rows.select("page", F.col("box_id").cast("long"), "kind", *[F.col(c).cast("double").alias(c) for c in BOX], "label", F.col("h").cast("double"))
    kinds = [rows.schema["page"], StructField("box_id", LongType()), StructField("kind", StringType()), *[StructField(c, DoubleType()) for c in BOX], StructField("label", StringType())]
    return fold_runs(rows, ["page"], ["box_id"], fold, StructType(kinds))


def _level(a, b) -> bool:
    return min(a[4], b[4]) - max(a[2], b[2]) >= 0.5 * max(min(a[4] - a[2], b[4] - b[2]), 0.1)


def handed_down(fields: list[tuple], h: float) -> list[str | None]:
    """Labels of fields (kind, l, t, r, b, label): narrow text fields in runs of three or more share the label of their
    first; then, from top to bottom, a text field without one takes that of the nearest field above in its column."""
    labels = [f[5] for f in fields]
    narrow = sorted((i for i, f in enumerate(fields) if f[0] == "text" and f[3] - f[1] <= 2.5 * h), key=lambda i: fields[i][1])
    settled = set()
    for first in narrow:
        if first in settled:
            continue
        run = [first]
        while True:
            last = fields[run[-1]]
            follows = (j for j in narrow if j not in run and _level(fields[j], last) and -0.3 * h <= fields[j][1] - last[3] <= 1.5 * (last[3] - last[1]))
            if (j := next(follows, None)) is None:
                break
            run.append(j)
        settled.add(first)
        if len(run) >= 3:
            settled.update(run)
            for j in run:
                labels[j] = labels[first]
    down = sorted(range(len(fields)), key=lambda i: fields[i][2])
    for i in down:
        kind, left, top, right = fields[i][:4]
        if labels[i] is not None or kind != "text":
            continue
        above = []
        for place, j in enumerate(down):
            _, a, _, c, d, _ = fields[j]
            if j != i and -0.3 * h <= top - d <= 2 * h and min(right, c) - max(left, a) >= 0.7 * min(right - left, c - a):
                above.append((top - d, place, j))
        if above:
            labels[i] = labels[min(above)[2]]
    return labels
