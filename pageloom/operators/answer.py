"""Answers to batches of questions, each asked of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from . import passages, search

PASSAGES = "array<struct<page:int,text:string,section:string>>"


def lexical_scorer(question: str, sentence: str) -> Column:
    """The named stand-in for a reranker: share of the question's tokens that the sentence has. Not a trained model."""
    q, s = F.array_distinct(T.search_words(F.col(question))), F.array_distinct(T.search_words(F.col(sentence)))
    return F.size(F.array_intersect(q, s)) / F.greatest(F.size(q), F.lit(1))


def candidates(chunks: DataFrame, questions: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """doc_id, q_id, question, page, section, pos, text: the distinct sentences of each question's eight best chunks, in
    the order of rank. scored: q_id, doc_id, chunk_ix, score, similarity, where other similarities than ours are used."""
    fused = search.rrf(scored if scored is not None else search.scored(chunks, questions))
    texts = chunks.select("doc_id", "chunk_ix", F.col("page").cast("int").alias("page"), "text", _section(chunks).alias("section"))
    best = search.top_chunks(fused).select("doc_id", "q_id", "chunk_ix", "rank").join(texts, ["doc_id", "chunk_ix"])
    cut = passages.sentences(best.select("doc_id", "q_id", "rank", "page", "section", "text"))
    cut = search.distinct_in_order(cut, ["sentence"], ["rank", "pos"], ["doc_id", "q_id"])
    cut = cut.select("doc_id", "q_id", "page", "section", F.col("nth").alias("pos"), F.col("sentence").alias("text"))
    return cut.join(questions.select("doc_id", "q_id", "question"), ["doc_id", "q_id"])


def _section(chunks: DataFrame) -> Column:
    return F.col("section") if "section" in chunks.columns else F.lit(None).cast("string")


def forms_of(chunks: DataFrame) -> DataFrame:
    """doc_id, form_pages (array), short (ten pages with text at most) of each document: a row of bounded size."""
    rows = passages.page_rows(passages.sentences(chunks.select("doc_id", "page", "text")).withColumnRenamed("sentence", "text"))
    marked = passages.form_flags(rows)
    pages = F.sort_array(F.collect_list(F.when(F.col("is_form"), F.col("page"))))
    return marked.groupBy("doc_id").agg(pages.alias("form_pages"), (F.count("*") <= C.FORM_MAX_PAGES).alias("short"))


def form_row_score(min_confidence: float) -> Column:
    """The score of a sentence that may answer as a form row, else null. Reads text, question, page, score, form_pages
    and short: on a form page a 'label: value' of which the question names half the label, off it a row of a short
    document whose whole label is named; a label named whole needs 0.4 only."""
    label, asked = F.col("label_words"), F.col("asked_words")
    named = F.size(F.filter(label, lambda w: F.exists(asked, lambda q: T.same_start(w, q))))
    whole, on_form = named == F.size(label), F.coalesce(F.array_contains("form_pages", F.col("page")), F.lit(False))
    usable = (on_form & T.is_label_value(F.col("text"))) | (F.coalesce("short", F.lit(False)) & T.is_row(F.col("text")))
    floor = F.when(whole, F.least(F.lit(min_confidence), F.lit(C.NAMED_FLOOR))).otherwise(F.lit(min_confidence))
    fits = usable & (F.size(label) > 0) & (on_form | whole) & (F.col("score") >= floor) & (2 * named >= F.size(label))
    return F.when(fits, F.col("score"))


def decide(scored: DataFrame, forms: DataFrame, min_confidence: float = C.MIN_CONFIDENCE, min_gap: float = C.MIN_GAP) -> DataFrame:
    """doc_id, q_id, kind ('found' or 'not_found'), confidence, passages (page, text, section) of each question.

    scored: doc_id, q_id, question, pos, page, section, text, score. The best sentence and its amendments, if it is sure
    and clear enough; else the best form row that the question names; else nothing, with the best score.
    """
    picked = search.pick(scored, ("doc_id", "q_id")).join(forms, "doc_id", "left")
    held = picked.withColumns({"label_words": T.label_words(T.label_of(F.col("text"))), "asked_words": T.label_words(F.col("question"))})
    held = held.withColumn("row_score", form_row_score(min_confidence))
    own = F.struct("page", "text", "section")
    out = held.groupBy("doc_id", "q_id").agg(
        F.max("best").alias("best"),
        F.max("gap").alias("gap"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct((F.col("kind") != "best").alias("later"), "pos", own.alias("p"))))).alias("ps"),
        F.min(F.when(F.col("row_score").isNotNull(), F.struct((-F.col("row_score")).alias("s"), "pos", own.alias("p")))).alias("row"),
    )
    clear = (F.col("best") >= min_confidence) & (F.col("gap") >= min_gap)
    by_row = ~clear & F.col("row").isNotNull()
    return out.select(
        "doc_id",
        "q_id",
        F.when(clear | by_row, "found").otherwise("not_found").alias("kind"),
        F.when(by_row, -F.col("row.s")).otherwise(F.col("best")).alias("confidence"),
        F.when(clear, F.transform("ps", lambda x: x["p"])).when(by_row, F.array("row.p")).otherwise(F.array().cast(PASSAGES)).alias("passages"),
    )


def answer(chunks: DataFrame, questions: DataFrame, scorer=lexical_scorer, scored: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """q_id, kind ('found', 'not_found' or 'wrong_language'), confidence, sentences and passages of each question.

    chunks: doc_id, chunk_ix, page, text and, if there is one, section. questions: q_id, doc_id, question. scorer takes
    the names of two columns, the question and the sentence as it is scored. refused: q_id of the questions that are in
    another language than their document; nothing is looked up for them.
    """
    asked = questions if refused is None else questions.join(refused.select("q_id"), "q_id", "left_anti")
    scope = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = candidates(scope, asked, scored).withColumn("shown", T.scoring_text(F.col("text")))
    judged = cut.withColumn("score", scorer("question", "shown")).drop("shown")
    out = decide(judged, forms_of(scope)).drop("doc_id")
    rest = questions.select("q_id").join(out, "q_id", "left")
    if refused is not None:
        rest = rest.join(refused.select("q_id", F.lit(True).alias("_refused")), "q_id", "left")
    kind = F.coalesce("kind", F.when(F.col("_refused"), "wrong_language") if refused is not None else F.lit(None), F.lit("not_found"))
    passage = F.coalesce("passages", F.array().cast(PASSAGES))
    return rest.select("q_id", kind.alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.transform(passage, lambda p: p["text"]).alias("sentences"), passage.alias("passages"))


def answer_json(answers: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """q_id and each answer as a JSON object, with the keys that its kind has. languages: q_id, document, question."""
    rows = answers if languages is None else answers.join(languages.select("q_id", "document", "question"), "q_id", "left")
    none = F.lit(None).cast("string")
    document, question = ("document", "question") if languages is not None else (none, none)
    only = lambda kind, c: F.when(F.col("kind") == kind, c)
    fields = [
        F.col("kind"),
        only("found", F.col("confidence")).alias("confidence"),
        only("found", F.col("passages")).alias("sentences"),
        only("not_found", F.col("confidence")).alias("bestConfidence"),
        only("wrong_language", F.col(document) if isinstance(document, str) else document).alias("document"),
        only("wrong_language", F.col(question) if isinstance(question, str) else question).alias("question"),
    ]
    return rows.select("q_id", F.to_json(F.struct(*fields)).alias("answer"))


def best_first(rows: DataFrame, key: str, score: str) -> DataFrame:
    """The row of the greatest score of each key, the first in the order of name on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "name")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
