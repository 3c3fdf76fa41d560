"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change is an insert (+1), a delete (-1) or a revision (-1 with the old count and +1 with the new one). A batch of
changes is summed by key before it is shuffled, and added to the totals under its id. The totals are a table of one row a
key: a commit writes a new version of it, with the ids of all batches that it holds and digests of what they added, so
neither reading nor committing looks at older batches again.

A version counts from the moment its state file is there, which is created last and never replaced; of two writers that
make the same version the second finds the file, and begins anew on top of it. A batch that is sent again, after any
failure, adds nothing; one that comes with a known id and other sums is refused. Versions but the last two are deleted.

Keys whose documents have all gone are not reported. Null sources and languages are keys of their own; null counts are 0.
An empty batch is a batch. Other columns than the keys and counts are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

KEY = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
BATCHES = "batch long, digest string"
KEPT = 2

# Tokenizer versions whose counts built-in functions give.
COUNTERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")),
    "words-2": lambda text: F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+")),
}


class OtherContent(ValueError):
    """A batch came again with a known id and other sums."""


def count_of(version: str, text: Column) -> Column:
    return F.coalesce(COUNTERS[version](text), F.lit(0)).cast("long")


def _changes(rows: DataFrame, sign: int, n: str) -> DataFrame:
    count = F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long"))
    return rows.select(*[F.col(k).cast("string").alias(k) for k in KEY], F.lit(sign).cast("long").alias("n_docs"), (sign * count).alias("n_tokens"))


def inserts(rows: DataFrame, n: str = "n_tokens") -> DataFrame:
    return _changes(rows, 1, n)


def deletes(rows: DataFrame, n: str = "n_tokens") -> DataFrame:
    return _changes(rows, -1, n)


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    return deletes(rows, old).unionByName(inserts(rows, new))


def net(changes: DataFrame) -> DataFrame:
    sums = changes.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs != 0 or n_tokens != 0")


def digest_of(sums: DataFrame) -> str:
    """A number, as text, that sums of other keys or counts hardly share; their order does not matter."""
    found = sums.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*KEY, "n_docs", "n_tokens").cast("decimal(38,0)")).alias("h")).first()
    return f"{found['n']}:{found['h']}"


class Rollup:
    """The totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, str | None]:
        """The last version and where its data is; (0, None) before the first."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return 0, None
        names = sorted((f.getPath().getName() for f in fs.listStatus(self._path()) if f.getPath().getName().startswith("state-")), reverse=True)
        for name in names:
            rows = self.spark.read.text(f"{self.folder}/{name}").collect()  # one line
            try:
                return int(name.removeprefix("state-")), json.loads(rows[0][0])["data"]
            except (IndexError, ValueError):
                continue  # its writer died: the version before it is the last
        return 0, None

    def _read(self, data: str | None, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{data}/{part}") if data else self.spark.createDataFrame([], schema)

    def _claim(self, version: int, data: str) -> bool:
        """Whether the version's state file could be made; it is there already if another writer was faster."""
        try:
            out = self._fs().create(self._path(f"state-{version:08d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps({"data": data}).encode()))
        out.close()
        return True

    def committed(self) -> list[int]:
        return sorted(r["batch"] for r in self._read(self._state()[1], "batches", BATCHES).collect())  # a row a batch

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Whether the batch was new. Raises OtherContent if its id is known with other sums."""
        sums = cut(net(changes))
        digest = digest_of(sums)
        while True:
            version, data = self._state()
            known = self._read(data, "batches", BATCHES)
            before = known.where(F.col("batch") == batch).first()
            if before is not None:
                if before["digest"] != digest:
                    raise OtherContent(f"batch {batch} was committed with other sums")
                return False
            new = f"data-{uuid.uuid4().hex}"
            net(self._read(data, "totals", SCHEMA).unionByName(sums)).coalesce(8).write.parquet(f"{self.folder}/{new}/totals")
            known.unionByName(self.spark.createDataFrame([(batch, digest)], BATCHES)).coalesce(1).write.parquet(f"{self.folder}/{new}/batches")
            if self._claim(version + 1, new):
                self._forget(version + 1)
                return True
            self._fs().delete(self._path(new), True)

    def _forget(self, version: int) -> None:
        """Deletes what is older than the last KEPT versions."""
        fs = self._fs()
        old = f"state-{version - KEPT:08d}"
        if version > KEPT and fs.exists(self._path(old)):
            rows = self.spark.read.text(f"{self.folder}/{old}").collect()
            try:
                fs.delete(self._path(json.loads(rows[0][0])["data"]), True)
            except (IndexError, ValueError):
                pass  # it never had any data
            fs.delete(self._path(old), False)

    def totals(self) -> DataFrame:
        return self._read(self._state()[1], "totals", SCHEMA).where("n_docs != 0")

    def delete(self) -> None:
        self._fs().delete(self._path(), True)
