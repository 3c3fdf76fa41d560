"""An extension of ours: documents that arrive as a stream are cut and indexed as they come.

Statistics are those of a document, so a document that arrives whole needs no state from earlier batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import search


def index_stream(pages: DataFrame, cut: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes chunks and postings of each batch under its id; a batch that is tried again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = cut(batch).persist()
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        search.postings(chunks).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        chunks.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
