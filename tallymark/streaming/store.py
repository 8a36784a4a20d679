"""Append-only tables written by micro-batches.

Each table is a folder with one part per micro-batch. A part is replaced as a
whole, so a micro-batch that runs twice leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "batch_id"


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def create(self) -> "Table":
        """Make sure the folder can be read before the first part exists."""
        self._part(self.spark.createDataFrame([], self.schema), -1)
        return self

    def _part(self, rows: DataFrame, batch_id: int) -> None:
        names = [f.name for f in self.schema.fields]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{PART}={batch_id}")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        self._part(rows, batch_id)

    def read(self) -> DataFrame:
        parts = T.StructType([*self.schema.fields, T.StructField(PART, T.LongType())])
        return self.spark.read.schema(parts).parquet(self.path)

    def before(self, batch_id: int) -> DataFrame:
        """What earlier micro-batches wrote; other parts are not opened."""
        return self.read().where(F.col(PART) < batch_id).drop(PART)

    def part(self, batch_id: int) -> DataFrame:
        return self.read().where(F.col(PART) == batch_id).drop(PART)

    def rows(self) -> DataFrame:
        return self.read().drop(PART)


def at_once(*jobs: Callable[[], None]) -> None:
    """Independent writes side by side: small ones leave most cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(job)) for job in jobs]:
            done.result()


def numbered(spark: SparkSession, folder: str, name: str, finished: bool = True) -> list[int]:
    """Numbers n of the folders `name=n` below `folder`; only those with the writer's mark of success if `finished`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        return []
    names = (s.getPath().getName() for s in files.listStatus(path(folder)) if s.isDirectory())
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))
    return [n for n in found if not finished or files.exists(path(f"{folder}/{name}={n}/_SUCCESS"))]


class KeyedTable:
    """Rows by key that micro-batches add, replace and remove; only changes are written.

    Commit n holds the changed rows and marks of removed ones; every
    `compact_every`-th commit is followed by a snapshot. A commit that is
    repeated replaces its part.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, compact_every: int = 16, once: bool = False):
        """`once`: a key is never added again, so that marks of removal settle what is left without an aggregation."""
        self.spark, self.path, self.compact_every, self.once = spark, path.rstrip("/"), compact_every, once
        self.names = [f.name for f in schema.fields]
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("gone", T.BooleanType()), *schema.fields])

    def commit(self, n: int, rows: DataFrame, removed: DataFrame) -> None:
        """`rows` have key and the columns of the table, `removed` has key."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[2:]]
        changes = rows.select("key", F.lit(False).alias("gone"), *self.names).unionByName(
            removed.select("key", F.lit(True).alias("gone"), *empty))
        changes.write.mode("overwrite").parquet(f"{self.path}/log/commit={n}")
        if (n + 1) % self.compact_every == 0:
            self._state(n, before=n).write.mode("overwrite").parquet(f"{self.path}/snapshots/commit={n}")

    def state(self, upto: int) -> DataFrame:
        """key and columns after commit `upto`."""
        return self._state(upto, upto + 1)

    def _state(self, upto: int, before: int) -> DataFrame:
        """From the last snapshot before `before`: one that is written again must not read itself."""
        since = max((s for s in numbered(self.spark, f"{self.path}/snapshots", "commit") if s < before), default=-1)
        later = [n for n in numbered(self.spark, f"{self.path}/log", "commit") if since < n <= upto]
        places = [f"{self.path}/log/commit={n}" for n in later]
        if since >= 0:
            places.append(f"{self.path}/snapshots/commit={since}")
        columns = [F.col(c) for c in ("key", *self.names)]
        if not places:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        # A snapshot has no `gone`: null there, as good as false.
        rows = self.spark.read.schema(self.schema).parquet(*places)
        gone = F.coalesce("gone", F.lit(False))
        if self.once:
            return rows.where(~gone).select(*columns).join(rows.where(gone).select("key"), "key", "left_anti")
        version = F.coalesce(F.regexp_extract(F.col("_metadata.file_path"), r"/log/commit=(\d+)/", 1).try_cast("bigint"), F.lit(-1))
        last = rows.select("*", version.alias("_n")).groupBy("key").agg(F.max_by(F.struct(gone.alias("gone"), *self.names), "_n").alias("x"))
        return last.where("NOT x.gone").select("key", *[F.col(f"x.{c}") for c in self.names])


def run_available(stream: DataFrame, handle, checkpoint: str) -> None:
    """Process everything that is there now, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def written(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """All rows that an append-only stream gives out for what is there now, as a table; each stands there once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def keep_running(stream: DataFrame, handle, checkpoint: str, every: str = "1 minute"):
    """The same job as a standing query."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
