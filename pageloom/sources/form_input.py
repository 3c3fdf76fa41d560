"""Form fields and page words from JSON, checked as they are read: a row that breaks the rules fails the job, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<id:bigint,page:bigint,bounds:array<double>,kind:string,options:array<string>,tooltip:string,readOnly:boolean>>"
PAGES = "array<struct<page:bigint,words:array<struct<text:string,bounds:array<double>>>>>"


def _parsed(column: str, schema: str) -> Column:
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def _checked(value: Column, good: Column, what: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)))


def _box(bounds: Column) -> list[Column]:
    good = (F.size(bounds) == 4) & F.forall(bounds, lambda v: v.isNotNull())
    checked = _checked(bounds, good, "bounds must be [left, top, right, bottom]")
    return [F.get(checked, F.lit(i)).alias(c) for i, c in enumerate("ltrb")]


def read_fields(rows: DataFrame, column: str = "fields") -> DataFrame:
    """form_id, field_ix, id, page, l, t, r, b, kind, options, tooltip, read_only of rows (form_id, a JSON array)."""
    whole = _checked(_parsed(column, FIELDS), _parsed(column, FIELDS).isNotNull() & F.col(column).rlike("^\\s*\\["), "fields: expected an array")
    f = rows.select("form_id", F.posexplode(whole).alias("field_ix", "f"))
    kinds = ("text", "checkbox", "choice")
    return f.select(
        "form_id",
        "field_ix",
        _checked(F.col("f.id"), F.col("f.id").isNotNull(), "field: id").alias("id"),
        _checked(F.col("f.page"), F.col("f.page").isNotNull(), "field: page").alias("page"),
        *_box(F.col("f.bounds")),
        _checked(F.col("f.kind"), F.col("f.kind").isin(*kinds), "field: kind must be text, checkbox or choice").alias("kind"),
        F.when(F.col("f.kind") == "choice", F.coalesce(F.filter("f.options", lambda o: o.isNotNull()), F.array().cast("array<string>"))).alias("options"),
        F.col("f.tooltip").alias("tooltip"),
        F.coalesce("f.readOnly", F.lit(False)).alias("read_only"),
    )


def read_words(rows: DataFrame, column: str = "pages") -> DataFrame:
    """form_id, entry, page, word_id, text, l, t, r, b of rows (form_id, a JSON array of pages with words)."""
    whole = _checked(_parsed(column, PAGES), _parsed(column, PAGES).isNotNull() & F.col(column).rlike("^\\s*\\["), "pages: expected an array")
    p = rows.select("form_id", F.posexplode(whole).alias("entry", "p"))
    words = _checked(F.col("p.words"), F.col("p.words").isNotNull(), "page: words")
    w = p.select("form_id", "entry", _checked(F.col("p.page"), F.col("p.page").isNotNull(), "page: page").alias("page"), F.posexplode(words).alias("word_id", "w"))
    return w.select("form_id", "entry", "page", "word_id", _checked(F.col("w.text"), F.col("w.text").isNotNull(), "page: word text").alias("text"), *_box(F.col("w.bounds")))
