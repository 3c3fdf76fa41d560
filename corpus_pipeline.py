"""A pipeline over documents: language, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, decontam, lang_id, near_dedup, secrets
from pageloom.llm.common import cut, matching, table
from pageloom.llm.queries import tokenizer_path

#: Cross entropy in bits a character, without phrases at the edges, beyond which a text is in none of the learned languages.
FOREIGN_BITS = 7.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, or like none of the languages, go.

    Learned from the documents themselves that have a lang: without any, all go, and an empty table stays empty. Null
    and blank texts go. Rows that repeat others have their fate. Other columns, whatever their names, stay.
    """
    prefix = "by_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = lang_id.identify(docs, lang_id.samples(docs), prefix)
    return found.where((F.col(f"{prefix}pred") != lang_id.UND) & (F.col(f"{prefix}sure") <= FOREIGN_BITS)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest doc_id.

    Texts that are null or blank are like nothing and stay, as do rows without doc_id. Rows that repeat a doc_id are one
    document and share its fate: all of them stay or go. Other columns stay as they are.
    """
    gone = cut(near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct())
    return matching(docs, gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and blank texts hold none and stay, as do rows without doc_id. Of rows that repeat a doc_id all go if one holds
    a passage. An empty benchmark keeps everything. Other columns stay as they are.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted anew where one was. Null texts stay null."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and of the text that they decode to: a row for every row.
    Null texts count as empty. Other columns are dropped."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: No stage but the counting of words can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
