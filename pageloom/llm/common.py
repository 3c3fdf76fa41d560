"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast; more of them go through a shuffle join instead.
BROADCAST_KEYS = 2_000_000
#: Bytes, by a count of rows, up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20


_held: list = [None, None]


def held(key, make):
    """What make gives, kept in this worker for the next task that asks for key. Only the last one asked for is kept, so
    that a worker that serves one operator after the other does not hold the tables of all."""
    if _held[0] != key:
        drop_held()
        _held[:] = [key, make()]
    return _held[1]


def drop_held() -> None:
    """Frees what this worker keeps for operators that ran before, and gives the memory back to the system."""
    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()


#: Rows in an Arrow batch. A row is a whole text, so the usual 10,000 are too many to hold on both sides at a time.
BATCH_ROWS = 256
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session was told to send whole texts to Python in batches of BATCH_ROWS rows at most. The setting is
    read when a plan is made, and stays for the session; a smaller one of the user's stays as it is."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer in use: it does so when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of the steps of a job, in a folder of their own within the shared one, and gone as soon as they are done
    with: drop() takes one that a later one has replaced, close() takes all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """df as it was written; lost executors cost no recomputation of what led to it."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.paths:
                self._delete(self.paths.pop(id(df))[1])

    def close(self) -> None:
        self.paths.clear()
        self._delete(self.root)
        release(self.spark)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as keep it apart from df's columns, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def matching(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df semi or anti joined with unique keys, which are broadcast only if they are counted as few."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)
