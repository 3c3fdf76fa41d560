"""Languages of documents and questions, and the refusal of questions in another language than their document's.

No trained model is at hand. marker_scores is a named stand-in: the share of the signs of each language (common words,
umlauts, letters of one language only), with one sign each to begin with. Any other scorer that gives the same columns
takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

LANGUAGES = ("english", "german", "persian", "arabic")


def marker_scores(c: Column) -> Column:
    """array<double> of confidences in the order of LANGUAGES, which sum to 1; null for a text without letters."""
    low = F.lower(c)
    counts = F.array(T.count_words(c, C.ENGLISH), T.count_words(c, C.GERMAN) + T.count_of(low, "[äöüß]"), T.count_of(c, "[پچژگ]"), T.count_of(c, "ة"))
    total = F.aggregate(counts, F.lit(0), lambda acc, n: acc + n) + len(LANGUAGES)
    return F.when(c.rlike("\\p{IsAlphabetic}"), F.transform(counts, lambda n: (n + 1) / total))


def scored_languages(texts: DataFrame, key: str, text: str, sample: int | None = None, scores=marker_scores) -> DataFrame:
    """key, name, confidence: a row for each language of each text that has letters; sample: characters looked at."""
    shown = F.left(F.col(text), F.lit(sample)) if sample else F.col(text)
    rows = texts.select(key, F.posexplode(scores(shown)).alias("at", "confidence"))
    return rows.select(key, F.element_at(F.array(*map(F.lit, LANGUAGES)), F.col("at") + 1).alias("name"), "at", "confidence")


def first_language(scored: DataFrame, key: str) -> DataFrame:
    """key, language, confidence: the likeliest, the first of equals."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "at", "name"))
    return scored.groupBy(key).agg(best.alias("x")).select(key, F.col("x.name").alias("language"), (-F.col("x.c")).alias("confidence"))


def document_languages(documents: DataFrame, scores=marker_scores) -> DataFrame:
    """doc_id, document: the language of the start of each document; no row for a text without letters."""
    found = first_language(scored_languages(documents, "doc_id", "text", C.LANGUAGE_SAMPLE, scores), "doc_id")
    return found.select("doc_id", F.col("language").alias("document"))


def refused(questions: DataFrame, documents: DataFrame, scores=marker_scores) -> DataFrame:
    """q_id, document, question (languages) of the questions that are clearly in another language than their document:
    the likeliest language is another one, and the document's own is less likely than 0.2."""
    scored = scored_languages(questions.select("q_id", "question"), "q_id", "question", None, scores)
    top = first_language(scored, "q_id").select("q_id", F.col("language").alias("question"))
    asked = questions.select("q_id", "doc_id").join(document_languages(documents, scores), "doc_id").join(top, "q_id")
    own = scored.select("q_id", F.col("name").alias("document"), F.col("confidence").alias("own"))
    return asked.join(own, ["q_id", "document"]).where((F.col("question") != F.col("document")) & (F.col("own") < C.REFUSE_BELOW)).select("q_id", "document", "question")


def page_language(script: Column, confidence: Column, text: Column) -> Column:
    """'en', 'de', 'fa' or 'ar' of a page read in its script's first language; null for another script or an unsure one."""
    return T.language_markers(text, T.accepted_script(script, confidence))
