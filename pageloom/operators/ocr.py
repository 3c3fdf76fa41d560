"""Scanned pages to text: grey and cleaned pictures, an injected recogniser, its rows as words, and the words as text.

pages: page_id, rgba (binary, four bytes a pixel), width, height and, for read(), languages (array of names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import Loader, recogniser, script_model
from ..sources import tsv
from . import image, layout


def read(pages: DataFrame, loader: Loader) -> tuple[DataFrame, DataFrame]:
    """(texts, words): page_id, text, confidence of each page with words; and its words with boxes and line_no.

    The recogniser takes the grey picture, its width and height, and the codes of the languages joined by +. Pictures of
    a wrong size give no words.
    """
    codes = F.array_join(F.transform("languages", T.ocr_code), "+")
    grey = image.cleaned_pages(pages).where("grey is not null").select("page_id", "grey", "width", "height", codes.alias("codes"))
    rows = grey.select("page_id", recogniser(loader)("grey", "width", "height", "codes").alias("tsv"))
    lines = rows.select("page_id", F.posexplode(F.split("tsv", "\n")).alias("ix", "row"))
    words = layout.lines(tsv.parse(lines)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / 100)))
    texts = layout.read_pages(words).join(layout.page_confidence(words), "page_id")
    return texts, words


def scripts(pages: DataFrame, loader: Loader) -> DataFrame:
    """page_id, script: the script of each page, if it is one that can be read and the model is sure of it; else null."""
    grey = image.cleaned_pages(pages).where("grey is not null")
    found = grey.select("page_id", script_model(loader)("grey", "width", "height").alias("s"))
    return found.select("page_id", T.accepted_script(F.col("s.script"), F.col("s.confidence")).alias("script"))


def languages(pages: DataFrame, script_loader: Loader, loader: Loader) -> DataFrame:
    """page_id, script, language: by the script, a reading in its first language, and the signs of either language in
    what was read. A page of another script, or without words, has no language."""
    found = scripts(pages, script_loader)
    known = pages.join(found.where("script is not null"), "page_id").withColumn("languages", F.slice(T.script_languages(F.col("script")), 1, 1))
    texts, _ = read(known, loader)
    rows = found.join(texts.select("page_id", "text"), "page_id", "left")
    return rows.select("page_id", "script", T.language_markers(F.col("text"), F.col("script")).alias("language"))
