"""A sink for alert, audit and dead-letter messages that leaves each message once.

Tasks write files of their own (one per attempt); a micro-batch counts once its
manifest names the files of the attempts that succeeded. The manifest of a
micro-batch is written under another name and moved, and never replaced: a
batch that fails halfway has none, and one that runs again finds its own. A
reader takes the files that manifests name; other files belong to nobody.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tallymark_messages"
MESSAGE = "topic string, key string, value string"


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Files:
    """What a task and the driver do, for a batch and for a stream."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path.rstrip("/"), names

    def write(self, rows: Iterator[Row]) -> Written:
        system, place = _system(self.path)
        system.create_dir(f"{place}/files", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{place}/files/{name}") as out:
            for row in rows:
                out.write(json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False, default=str).encode() + b"\n")
                n += 1
        return Written(name, n)

    def _commit(self, label: str, messages: list) -> None:
        system, place = _system(self.path)
        system.create_dir(f"{place}/commits", recursive=True)
        final = f"{place}/commits/{label}.json"
        if system.get_file_info(final).type != pafs.FileType.NotFound:
            return
        draft = f"{place}/commits/_{label}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps([{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]).encode())
        system.move(draft, final)


class _StreamFiles(_Files, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(f"batch-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        """Files without a manifest count for nothing."""


class _BatchFiles(_Files, DataSourceWriter):
    def __init__(self, path: str, names: list[str], label: str):
        super().__init__(path, names)
        self.label = label

    def commit(self, messages: list) -> None:
        self._commit(self.label, messages)

    def abort(self, messages: list) -> None:
        """Files without a manifest count for nothing."""


class MessageSink(DataSource):
    """Options: `path`; for a batch also `label`, a name under which it is committed at most once."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchFiles(self.options["path"], schema.names, self.options.get("label") or uuid.uuid4().hex)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamFiles(self.options["path"], schema.names)


def send(messages: DataFrame, path: str, label: str) -> None:
    """Writes messages under a label, once however often it is tried."""
    messages.sparkSession.dataSource.register(MessageSink)
    messages.select("topic", "key", "value").write.format(FORMAT).option("path", path).option("label", label).mode("append").save()


def send_stream(messages: DataFrame, path: str, checkpoint: str):
    """A standing query that writes a stream's messages, each once; for what is there now."""
    messages.sparkSession.dataSource.register(MessageSink)
    return messages.select("topic", "key", "value").writeStream.format(FORMAT).option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sent(spark: SparkSession, path: str) -> DataFrame:
    """All messages of committed batches, with the name of the commit."""
    place = path.rstrip("/")
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_class(f"{place}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{MESSAGE}, commit string")
    named = spark.read.schema("file string, rows bigint").option("multiLine", "true").json(f"{place}/commits/*.json").select(
        "file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("commit"))
    rows = spark.read.schema(MESSAGE).json(f"{place}/files").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(named, "file").drop("file")
