"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, hilbert, lang_id, media, near_dedup, rollup, secrets, warc
from .common import cut, shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.prefix_target_examples(turns.unionByName(odd)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = lang_id.samples(docs, exclude=lang_id.held_out("doc_id"))
    found = lang_id.identify(docs.select("doc_id", F.col("text").cast("string")), learned)
    return found.select("doc_id", F.coalesce(lang_id.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits"))


def op5_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored_texts(table(spark, sf_dir, "documents")))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.shard_documents(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records made from pages: each page is a full response, and is asked for again later."""
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), tag.alias("tag"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    heads = lambda date: F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Date"), date.cast("string"))
    full = base.select((2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.concat(F.lit('"'), "tag", F.lit('"')).alias("etag"), F.lit(None).cast("string").alias("last_modified"), "tag", heads(2 * F.col("page_id")).alias("headers"))
    again = base.select((2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * F.col("page_id") + 20001).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit('W/"'), "tag", F.lit('"')).alias("etag"), F.lit(None).cast("string").alias("last_modified"), "tag", heads(2 * F.col("page_id") + 20001).alias("headers"))
    return full.unionByName(again).withColumnRenamed("tag", "digest")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "target_id", "state", F.element_at("headers", "date").alias("date"), F.element_at("headers", "content-length").alias("content_length"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents by words, then a move of four in ten to BPE tokens, and at last deletes and recounts.

    The tokenizer runs over the documents that it counts, those that are moved; the recounted ones get the second rule.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    gone, recounted, moves = "doc_id % 10 = 7", "doc_id % 10 = 5", F.coalesce(F.col("doc_id") % 10 < 4, F.lit(False))
    words = docs.select("doc_id", "source", "lang", moves.alias("moves"), rollup.count_of("words-1", F.col("text")).alias("n1"), rollup.count_of("words-2", F.col("text")).alias("n2"))
    counted = bpe.count_tokens(docs.where(moves), tokenizer_path(), "n2").drop("text")
    first = cut(words).withColumn("tokenizer", F.lit("words-1"))
    moved = first.where("moves")
    book = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    book.commit(1, rollup.inserts(first, "n1"))
    changes = rollup.deletes(moved, "n1").unionByName(rollup.inserts(counted.withColumn("tokenizer", F.lit("bpe-49k")), "n2"))
    changes = cut(rollup.net(changes))
    book.commit(2, changes)
    book.commit(2, changes)
    book.commit(3, rollup.deletes(first.where(gone), "n1").unionByName(rollup.revisions(first.where(recounted), "n1", "n2")))
    found = cut(book.totals())
    book.delete()
    return found


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_secret_scan, op3_decontamination, op4_language_id, op5_media_webp, op6_hilbert_shards, op7_bpe, op8_warc_revisits, op9_token_rollup, op10_near_dedup)}


_CHAT = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, 23 + length(role || text) + length(role || text)
    - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '[', '')) as chars,
    row_number() over (partition by conv_id order by turn, role, text) as pos
  from t
), c as (
  select *, sum(chars) over (partition by conv_id order by pos) as upto from e
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by pos), '')) as loss_sha256,
  (sum(chars) + coalesce(sum(case when role = 'assistant' then upto end), 0))::bigint as formatted_chars
from c group by conv_id
"""

_WARC = """
with u as (
  select page_id, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as n, regexp_replace(trim(url), '#.*$', '') as bare from pages
), p as (
  select page_id, tag, n, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), '^www\\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as place,
    list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(?i:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as args
  from u
), k as (
  select page_id, tag, n, place || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as canonical_url from p
), r as (
  select 2 * page_id as record_id, canonical_url, 2 * page_id as ts, 1 as is_full, tag, n from k
  union all select 2 * page_id + 1, canonical_url, 2 * page_id + 20001, 0, tag, n from k
), w as (
  select *, last_value(case when is_full = 1 then {'id': record_id, 'tag': tag, 'n': n} end ignore nulls)
    over (partition by canonical_url order by ts, is_full, record_id rows between unbounded preceding and 1 preceding) as f from r
)
select record_id, canonical_url, f.id as target_id,
  case when f is null then 'missing' when f.tag = tag then 'resolved' else 'mismatch' end as state,
  case when f.tag = tag then ts::varchar end as date, case when f.tag = tag then f.n::varchar end as content_length
from w where is_full = 0
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _CHAT, "op8_warc_revisits": _WARC}
