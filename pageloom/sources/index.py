"""The prepared index as Parquet: postings, chunks and document statistics beside the keys that they depend on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

FORMAT = 3


class IndexMismatch(ValueError):
    """The saved index was made with another format, embedder or way of cutting."""


def fingerprint(*files: bytes) -> str:
    """64-bit FNV-1a over 8-byte words, then each file's tail bytes and length; as hex."""
    h = 0xCBF29CE484222325
    for data in files:
        whole = len(data) // 8 * 8
        for word in memoryview(data[:whole]).cast("Q") if whole else ():
            h = ((h ^ word) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        for b in (*data[whole:], len(data)):
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def save(chunks: DataFrame, folder: str, embedder: str, chunking: str) -> None:
    key = {"format": FORMAT, "embedder": embedder, "chunking": chunking}
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    search.postings(chunks).write.mode("overwrite").parquet(f"{folder}/postings")
    search.chunk_stats(chunks).write.mode("overwrite").parquet(f"{folder}/stats")
    chunks.sparkSession.createDataFrame([(json.dumps(key, sort_keys=True),)], "key string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/key")


def load(spark: SparkSession, folder: str, embedder: str, chunking: str) -> dict[str, DataFrame]:
    key = json.dumps({"format": FORMAT, "embedder": embedder, "chunking": chunking}, sort_keys=True)
    found = [r[0] for r in spark.read.parquet(f"{folder}/key").limit(2).collect()]
    if found != [key]:
        raise IndexMismatch(f"the index has the key {found}, not {key}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "postings", "stats")}


def chunk_fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: a digest of all chunks that does not depend on their order."""
    return chunks.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "chunk_ix", "text").cast("decimal(38,0)")).alias("digest"))
