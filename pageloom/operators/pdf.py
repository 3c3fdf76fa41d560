"""Page text from the positioned pieces of a PDF: forms row by row, and run-together rows cut at the printed lines.

No PDF reader is at hand, so the pieces are a table: page_id, piece_ix, kind ('text' or 'field'), x, y (lower edge, y
upward), width, height, rotation, text. pages: page_id, markdown, columns and tables (whether either was found on it).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import folds, grids
from ..functions import text as T
from ..functions.runs import fold_runs


def upright(pieces: DataFrame) -> DataFrame:
    """Pieces of text and of form fields that are not blank and stand upright; others tie rows together."""
    return pieces.where(F.col("kind").isin("text", "field") & (F.abs("rotation") < 1.0) & (T.bare(F.col("text")) != ""))


def grid_pages(pages: DataFrame) -> DataFrame:
    """page_id of pages with columns, but without tables, which are read by row already."""
    return pages.where("columns").select("page_id").join(pages.where("tables").select("page_id"), "page_id", "left_anti")


def flat_pages(pages: DataFrame) -> DataFrame:
    """page_id of pages with a paragraph that may be rows run together."""
    return pages.where(F.exists(F.split("markdown", "\n\n"), T.maybe_rows)).select("page_id")


def _read(pieces: DataFrame) -> DataFrame:
    """page_id, grid (the page row by row; null if it is no form) and printed (its lines)."""

    def fold(rows):
        own = [grids.Piece(*r[2:]) for r in rows]
        return [(rows[0][0], grids.piece_grid(own), grids.printed_lines(own))]

    rows = pieces.select("page_id", "piece_ix", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], "text", (F.col("kind") == "field").alias("field"))
    kinds = [rows.schema["page_id"], StructField("grid", StringType()), StructField("printed", ArrayType(StringType()))]
    return fold_runs(rows, ["page_id"], ["piece_ix"], fold, StructType(kinds))


def cut_at_lines(markdown: str, printed: list[str]) -> str:
    """The paragraphs of a page, those of run-together rows cut where the printed lines end."""
    flat = lambda p: "\n" not in p.strip() and p.count(": ") >= 3
    return "\n\n".join((flat(p) and folds.printed_rows(p, printed)) or p for p in markdown.split("\n\n"))


@F.pandas_udf(StringType())
def _cut(markdown: pd.Series, printed: pd.Series) -> pd.Series:
    return pd.Series([cut_at_lines(m, [] if p is None else list(p)) for m, p in zip(markdown, printed, strict=True)])


def page_text(pages: DataFrame, pieces: DataFrame) -> DataFrame:
    """page_id, text: pages of columns row by row if they are forms, pages of run-together rows cut at the printed
    lines, and the markdown of all others. Only pages that need them have their pieces read."""
    grid, flat = grid_pages(pages).withColumn("is_grid", F.lit(True)), flat_pages(pages).withColumn("is_flat", F.lit(True))
    marked = pages.select("page_id", "markdown").join(grid, "page_id", "left").join(flat, "page_id", "left")
    needed = marked.where("is_grid or is_flat").select("page_id")
    read = _read(upright(pieces).join(needed, "page_id", "left_semi"))
    rows = marked.join(read, "page_id", "left")
    by_row = F.when(F.col("is_grid"), F.col("grid"))
    plain, flat_rows = rows.where(by_row.isNotNull() | F.col("is_flat").isNull()), rows.where(by_row.isNull() & F.col("is_flat"))
    return plain.select("page_id", F.coalesce(by_row, "markdown").alias("text")).unionByName(flat_rows.select("page_id", _cut("markdown", "printed").alias("text")))
