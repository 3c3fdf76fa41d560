"""Retrieval within documents: postings, BM25, similarity, rank fusion, best passages. All per document, all built-in.

Questions meet the chunks of their document in one join by doc_id; everything after it is a window or a sum over keys
that begin with doc_id, and so needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def counted(words: Column) -> Column:
    """array<struct<token, tf>> of an array of words, by sorting it. words is to be a column, not an expression."""
    at = lambda i: F.get(words, i)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(words)), F.array(F.size(words)))
    return F.when(F.size(words) > 0, F.zip_with(starts, ends, lambda a, b: F.struct(at(a).alias("token"), (b - a).cast("long").alias("tf"))))


def postings(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_ix, token, tf. A chunk is a row, so its tokens are counted where it is, without a shuffle."""
    held = chunks.select("doc_id", "chunk_ix", F.explode(F.array(F.array_sort(T.search_words(F.col("text"))))).alias("words"))
    return held.select("doc_id", "chunk_ix", F.inline(counted(F.col("words"))))


def doc_freq(terms: DataFrame) -> DataFrame:
    """doc_id, token, df of postings: every row is a chunk of its own."""
    return terms.groupBy("doc_id", "token").agg(F.count("*").alias("df"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, avg_len over all chunks, empty ones included (1 at least)."""
    sized = chunks.select("doc_id", F.size(T.search_words(F.coalesce("text", F.lit("")))).alias("len"))
    return sized.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def idf(n, df) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf, length, average) -> Column:
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / average))


def scored(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, doc_id, chunk_ix, score (BM25) and similarity of every chunk of the question's document.

    questions: q_id, doc_id, question. A word asked twice counts twice; statistics are those of the document.
    similarity is the named stand-in for vectors: the share of the question's distinct tokens that the chunk has.
    """
    cut = chunks.select("doc_id", "chunk_ix", T.search_words(F.coalesce("text", F.lit(""))).alias("words"))
    asked = questions.select("q_id", "doc_id", F.explode(F.array(F.array_sort(T.search_words(F.col("question"))))).alias("asked"))
    asked = asked.select("q_id", "doc_id", F.coalesce(counted(F.col("asked")), F.array().cast("array<struct<token:string,tf:bigint>>")).alias("asked"))
    both = cut.join(asked, "doc_id")
    tfs = F.transform("asked", lambda a: F.size(F.filter("words", lambda w: w == a["token"])))
    rows = both.select("q_id", "doc_id", "chunk_ix", F.size("words").alias("len"), "asked", tfs.alias("tfs"))
    every = Window.partitionBy("doc_id", "q_id")
    rows = rows.withColumns({"n": F.count("*").over(every), "average": F.greatest(F.avg("len").over(every), F.lit(1.0))})
    each = rows.select("*", F.posexplode_outer(F.arrays_zip("asked", "tfs")).alias("at", "x")).withColumn("tf", F.coalesce("x.tfs", F.lit(0)))
    each = each.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy("doc_id", "q_id", "at")))
    part = F.when(F.col("tf") > 0, F.col("x.asked.tf") * idf(F.col("n"), F.col("df")) * bm25_weight(F.col("tf"), F.col("len"), F.col("average")))
    sums = each.groupBy("doc_id", "q_id", "chunk_ix").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"), (F.count_if(F.col("tf") > 0) / F.greatest(F.count("x"), F.lit(1))).alias("similarity"))
    return sums.select("q_id", "doc_id", "chunk_ix", "score", "similarity")


def bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, doc_id, chunk_ix, score of every chunk of the question's document; 0 without a common token."""
    return scored(chunks, questions).drop("similarity")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def unit(df: DataFrame, vector: str, least: float | None = None) -> DataFrame:
    """df with vector scaled to length 1, as doubles. A vector of length 0 gives nulls, or zeros where least bounds the
    length that is divided by."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    norm = F.greatest(norm, F.lit(least)) if least is not None else norm
    held = df.withColumn("_norm", norm)
    return held.withColumn(vector, F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.col("_norm")))).drop("_norm")


def similarity_topk(queries: DataFrame, vectors: DataFrame, k: int, parts: int = 16) -> DataFrame:
    """q_id, vec_id, score, rank: the k nearest of each query's vectors by rounded dot product, then vec_id.

    queries: q_id, scope, q; vectors: vec_id, scope, v; joined on scope. Vectors are dealt to parts of their scope, so
    that a scope of many vectors is no single task, and each part passes on its own k best only.
    """
    dealt = vectors.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asked.join(dealt, ["scope", "_part"]).select("q_id", "scope", "_part", "vec_id", F.round(dot("q", "v"), 6).alias("score"))
    order = (F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "_part", "q_id").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("rank") <= k).select("q_id", "vec_id", "score", "rank")


def _of_question(*order) -> Window:
    return Window.partitionBy("doc_id", "q_id").orderBy(*order)


def ranks(scores: DataFrame, name: str, by: str = "score") -> DataFrame:
    """scores with name, the place from 0 of each chunk in the order of by, the first of equals ahead."""
    return scores.withColumn(name, F.row_number().over(_of_question(F.desc(by), "chunk_ix")) - 1)


def rrf(both: DataFrame) -> DataFrame:
    """q_id, doc_id, chunk_ix, fused: sums of 1 / (60 + rank from 0); keywords count only if any score is positive.

    both: q_id, doc_id, chunk_ix, score (keywords), similarity.
    """
    rows = both.withColumns({"score": F.round("score", 6), "similarity": F.round("similarity", 6)})
    rows = ranks(ranks(rows, "k_rank"), "v_rank", "similarity").withColumn("any_k", F.max("score").over(Window.partitionBy("doc_id", "q_id")) > 0)
    fused = 1 / (C.RRF_K + F.col("v_rank")) + F.when(F.col("any_k"), 1 / (C.RRF_K + F.col("k_rank"))).otherwise(0.0)
    return rows.select("q_id", "doc_id", "chunk_ix", fused.alias("fused"))


def top_chunks(fused: DataFrame, k: int = C.CHUNKS_KEPT) -> DataFrame:
    return fused.withColumn("rank", F.row_number().over(_of_question(F.desc(F.round("fused", 9)), "chunk_ix"))).where(F.col("rank") <= k)


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def distinct_in_order(rows: DataFrame, keys: list[str], order: list[str], scope: list[str]) -> DataFrame:
    """The first row of each keys, with nth, its number from 0 in order within scope."""
    first = dedup_first(rows, [*scope, *keys], order)
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1)


def pick(rows: DataFrame, key: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """rows (key, pos, text, score) with rn, kind ('best', 'amendment' or null), best and gap of each sentence.

    The best is the first of the greatest score; up to two amendments of 0.3 of it join in the order of the text. gap:
    how far the best is ahead of the first sentence that was not picked; 1.0 if there is none, and if the best is an
    amendment itself, whose clause scores close to it by nature.
    """
    own = Window.partitionBy(*key)
    rows = rows.withColumn("rn", F.row_number().over(own.orderBy(F.desc("score"), "pos"))).withColumn("best", F.max("score").over(own))
    rows = rows.withColumn("amends", T.is_amendment(F.col("text")))
    may = F.col("amends") & (F.col("rn") > 1) & (F.col("score") >= C.AMENDMENT_SHARE * F.col("best"))
    in_text = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.sum(may.cast("int")).over(in_text))
    rows = rows.withColumn("kind", F.when(F.col("rn") == 1, "best").when(may & (F.col("nth") <= C.MAX_AMENDMENTS), "amendment"))
    rows = rows.withColumn("rival", F.min(F.when(F.col("kind").isNull(), F.struct("rn", "score"))).over(own))
    led = F.bool_or((F.col("rn") == 1) & F.col("amends")).over(own)
    gap = F.when(led | F.col("rival").isNull(), 1.0).otherwise(F.col("best") - F.col("rival.score"))
    return rows.withColumn("gap", gap).drop("nth", "rival", "amends")
