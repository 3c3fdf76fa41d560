"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to BITS bits without looking at the data: sizes on a logarithmic scale, names by a hash
(names of a few values keep apart, names of many spread). The curve index of the cell orders the rows; doc_id, size and
the text's crc32 break ties. The order is cut into runs of equal counts (law `rows`: at most one apart), so that a file
covers a small box of every dimension and filters on any of them can skip most files.

Null sizes and names fall into cell 0. Rows that agree in all of that are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

BITS = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of rows of unsigned coordinates (n, dims): axes to transposed index (Skilling 2004), interleaved."""
    x = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[-1] >> np.uint64(b)) & one, t ^ ((one << np.uint64(b)) - one), t)
    x = [c ^ t for c in x]
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << one) | ((c >> np.uint64(b)) & one)
    return out.astype(np.int64)


def log_cell(size: Column) -> Column:
    """Sizes from 0 on a scale of eight cells to a doubling."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 1) * 8)).cast("int")


def name_cell(name: Column) -> Column:
    return F.coalesce(1 + F.pmod(F.crc32(name.cast("string").cast("binary")), F.lit((1 << BITS) - 1)), F.lit(0)).cast("int")


def curve_ordered(df: DataFrame, cells: list[Column], ties: list[str]) -> DataFrame:
    """df with `curve`, `rank`, its place from 0 in the order of curve and ties, and `total`, the number of rows; columns
    of df with these names are replaced."""

    @F.pandas_udf("long")
    def index(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(hilbert_index(np.column_stack([p.to_numpy() for p in parts]), BITS))

    rows = df.withColumn("curve", index(*cells))
    order = ["curve", *ties]
    n = max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part, at, first = unused(rows, "part", "at", "first")
    # the checkpoint keeps the partitions as they are, so that a row's number within its own stays true
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy(part).count()  # one row a partition
    upto = Window.orderBy(part)
    before = counts.select(part, (F.sum("count").over(upto) - F.col("count")).alias(first), F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rows = rows.drop("rank", "total").join(F.broadcast(before), part)
    return rows.withColumn("rank", F.col(first) + F.col(at)).drop(part, at, first)


def into_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """shard and slot of rows with rank and total: shard s holds the ranks from s * total / shards on."""
    shard = F.expr(f"(((rank + 1) * {shards} - 1) div total)")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - F.expr(f"((shard * total) div {shards})"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of all rows, along the curve of size, language and source."""
    text = F.col("text").cast("string").cast("binary")
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        *extra,
    )
    cells = [log_cell(F.col("size")), name_cell(F.col("lang")), name_cell(F.col("source"))]
    return into_runs(curve_ordered(rows, cells, ["doc_id", "size", "text_crc32"]), shards).drop("rank", "total", "lang", "source")
