"""Pages to passages to sentences: the ordered folds run per document or per row, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .. import config as C
from ..functions import folds
from ..functions import text as T
from ..functions.runs import fold_runs


@F.pandas_udf(ArrayType(StringType()))
def sentences_udf(texts: pd.Series) -> pd.Series:
    return texts.map(folds.sentences_of)


def chunks(pages: DataFrame, heading_paragraph: bool = False) -> DataFrame:
    """doc_id, chunk_ix, page, text, section of pages (doc_id, page, text)."""

    def fold(rows):
        found = folds.chunk_pages([r[1:] for r in rows], heading_paragraph)
        return [(rows[0][0], i, *r) for i, r in enumerate(found)]

    rows = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text")
    kinds = (("doc_id", LongType()), ("chunk_ix", IntegerType()), ("page", IntegerType()), ("text", StringType()), ("section", StringType()))
    return fold_runs(rows, ["doc_id"], ["page"], fold, StructType([StructField(*k) for k in kinds]))


def line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_ix, page (1), text: the adapter for plain documents, where each line is a paragraph."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_ix", "text"))
    return rows.select("doc_id", "chunk_ix", F.lit(1).alias("page"), F.trim("text").alias("text")).where("text != ''")


def sentences(rows: DataFrame) -> DataFrame:
    """rows with pos and sentence, one row per sentence of text."""
    return rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(sentences_udf("text")).alias("pos", "sentence"))


def simple_sentences(rows: DataFrame) -> DataFrame:
    """doc_id, chunk_ix, pos, sentence: text cut at blanks behind an end mark, by built-in functions alone."""
    return rows.select("doc_id", "chunk_ix", F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("pos", "sentence")).where("sentence != ''")


def sections(lines: DataFrame) -> DataFrame:
    """lines (doc_id, ix, text) with section: the last heading above, null on headings themselves."""
    heading = F.when(F.col("text").startswith("#"), F.trim(F.regexp_replace("text", "^#+", "")))
    w = Window.partitionBy("doc_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("section", F.when(heading.isNull(), F.last(heading, ignorenulls=True).over(w)))


def page_rows(rows: DataFrame) -> DataFrame:
    """doc_id, page, n, r: sentences and form rows of each page. rows: doc_id, page, text (one sentence each)."""
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if(T.is_row(F.col("text"))).alias("r"))


def form_flags(by_page: DataFrame) -> DataFrame:
    """by_page (doc_id, page, n, r) with is_form.

    All pages of a document with rows, if those are 0.4 of it or more; else, with at most ten pages, those with three
    rows or more that make up 0.4 of the page.
    """
    w = Window.partitionBy("doc_id")
    share = lambda r, n: r >= C.FORM_SHARE * F.greatest(n, F.lit(1))
    whole = (F.sum("r").over(w) > 0) & share(F.sum("r").over(w), F.sum("n").over(w))
    own = (F.count("*").over(w) <= C.FORM_MAX_PAGES) & (F.col("r") >= C.FORM_MIN_ROWS) & share(F.col("r"), F.col("n"))
    return by_page.withColumn("is_form", whole | own)


def form_pages(rows: DataFrame) -> DataFrame:
    """doc_id, page of the pages that are forms; rows: doc_id, page, text (one sentence each)."""
    return form_flags(page_rows(rows)).where("is_form").select("doc_id", "page")


def first_headings(pages: DataFrame) -> DataFrame:
    """pages (text) with heading: the first line that begins with #, without its marks; null if there is none."""
    head = F.regexp_extract("text", "(?m)^(#.*)$", 1)
    return pages.withColumn("heading", F.when(head != "", F.trim(F.regexp_replace(head, "^[# ]+", ""))))
