"""Ordered folds over the rows of a key: rows are dealt by key and sorted, then folded as they stream by.

Many small groups cost no more than their rows, unlike a call with a frame for each group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[tuple]


def fold_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Rows], Rows], schema: StructType) -> DataFrame:
    """fn of the rows of each key, in order, as rows of schema."""
    at = [df.columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(batches):
        def batch(rows: Rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: Rows = []
        for _, rows in groupby(stream, key=lambda r: tuple(r[i] for i in at)):
            out += fn(list(rows))
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
