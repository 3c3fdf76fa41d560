"""OCR words from tab-separated rows of twelve columns or more, level 5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("level", "page", "block", "par", "line", "word", "l", "t", "w", "h", "conf", "text")


def parse(rows: DataFrame, line: str = "row") -> DataFrame:
    """The columns of rows but line, and block, par, line, l, t, r, b, conf, text; rows that do not parse, or are blank, fall
    away."""
    own = [c for c in rows.columns if c != line]
    cells = F.col("cells")
    part = lambda i, kind: F.get(cells, F.lit(i)).try_cast(kind)
    split = rows.select(*own, F.explode(F.array(F.split(line, "\t"))).alias("cells"))  # split once, not once a cell
    parsed = split.where(F.size(cells) >= len(COLUMNS)).select(*own, *[part(i, "int").alias(c) for i, c in enumerate(COLUMNS[:10])], part(10, "double").alias("conf"), F.trim(F.get(cells, F.lit(11))).alias("text"))
    whole = parsed.where("level = 5 and text != ''").dropna(subset=[*COLUMNS[2:5], "l", "t", "w", "h", "conf"])
    return whole.select(*own, "block", "par", "line", "l", "t", (F.col("l") + F.col("w")).alias("r"), (F.col("t") + F.col("h")).alias("b"), "conf", "text")
