"""OCR words to lines, cells, paragraphs and page text, with windows over the order of the words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import config as C
from ..functions import grids
from ..functions.runs import fold_runs
from .geometry import upper_median


def lines(words: DataFrame) -> DataFrame:
    """words with line_no: a new line where (block, par, line) differs from the word before; words have ix."""
    w = Window.partitionBy("page_id").orderBy("ix")
    key = F.struct("block", "par", "line")
    new = F.when(F.lag(key).over(w) == key, 0).otherwise(1)
    return words.withColumn("new", new).withColumn("line_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def line_boxes(numbered: DataFrame) -> DataFrame:
    """page_id, line_no, block, l, t, r, b, conf (upper median), text of each line."""
    return numbered.groupBy("page_id", "line_no").agg(
        F.min("block").alias("block"),
        *[F.min(c).alias(c) for c in ("l", "t")],
        *[F.max(c).alias(c) for c in ("r", "b")],
        upper_median("conf").alias("conf"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def cells(numbered: DataFrame) -> DataFrame:
    """words with cell: a new one after a gap of more than 1.5 medians of the page's word heights."""
    heights = numbered.groupBy("page_id").agg(upper_median("b - t").alias("h"))
    w = Window.partitionBy("page_id", "line_no").orderBy("l", "ix")
    edge = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("l") - edge > C.CELL_GAP * F.col("h"), 1).otherwise(0)
    return numbered.join(heights, "page_id").withColumn("new", new).withColumn("cell", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "h")


def paragraphs(boxes: DataFrame) -> DataFrame:
    """Lines with paragraph: a new one at another block or after a gap of more than 0.9 medians."""
    heights = boxes.groupBy("page_id").agg(upper_median("b - t").alias("h"))
    w = Window.partitionBy("page_id").orderBy("line_no")
    new = F.when((F.lag("block").over(w) != F.col("block")) | (F.col("t") - F.lag("b").over(w) > C.PARAGRAPH_GAP * F.col("h")), 1).otherwise(0)
    return boxes.join(heights, "page_id").withColumn("new", new).withColumn("paragraph", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "h")


def page_text(pars: DataFrame) -> DataFrame:
    """page_id and text: lines joined by a newline, paragraphs by a blank line."""
    by = pars.groupBy("page_id", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("p"))
    return by.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "p"))), lambda x: x["p"]), "\n\n").alias("text"))


def page_confidence(words: DataFrame) -> DataFrame:
    """page_id, confidence: the upper median of the words' confidences, from 0 to 1."""
    return words.groupBy("page_id").agg((upper_median("conf") / 100).alias("confidence"))


def read_pages(words: DataFrame) -> DataFrame:
    """page_id, text: forms row by row, labels over their values as rows, and else paragraphs.

    words: page_id, ix (their order), block, par, line, l, t, r, b, text. A page's words meet in one task.
    """

    def fold(rows):
        lines, key = [], None
        for page, _, block, par, line, left, top, right, bottom, text in rows:
            if (block, par, line) != key:
                key = (block, par, line)
                lines.append(grids.Line(block))
            lines[-1].add(text, left, top, right, bottom)
        return [(rows[0][0], grids.page_text(lines))]

    rows = words.select("page_id", "ix", "block", "par", "line", *[F.col(c).cast("double").alias(c) for c in ("l", "t", "r", "b")], "text")
    return fold_runs(rows, ["page_id"], ["ix"], fold, StructType([rows.schema["page_id"], StructField("text", StringType())]))
