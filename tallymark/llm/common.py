"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc
import io
import math
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import materialise, run_folder

__all__ = ["ship", "file_system", "materialise", "run_folder", "table", "documents", "rows_of", "few", "settle", "words", "ascii_lower", "tasks_for", "tokenizer"]

#: ASCII white space as a Java class.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for Python code in tasks."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    folder = run_folder(spark, "code")
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/tallymark.zip") as sink:
        sink.write(packed.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/tallymark.zip")
    _SHIPPED.add(app)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A side of a join is broadcast up to so many narrow rows (a few numbers each, about 100 MB at most), found by counting.
BROADCAST_ROWS = 1_000_000


def few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows as a table, to be broadcast if there are at most `most` of them; else the session picks the join."""
    kept = materialise(rows)
    return F.broadcast(kept) if kept.count() <= (BROADCAST_ROWS if most is None else most) else kept


def settle(spark: SparkSession) -> None:
    """Lets the driver drop what no frame needs any more; Spark then deletes the shuffle files behind it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries, only one of them turned into Python values at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
        pa.default_memory_pool().release_unused()


def documents(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text as an empty one."""
    return frame.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def words(text: Column, gap: str = SPACE) -> Column:
    """The maximal runs of characters outside `gap`, in order."""
    return F.array_remove(F.split(text, f"{gap}+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    `lower` is the fast way and right wherever there is no other letter.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def tasks_for(rows: int, per_task: int, least: int = 1) -> int:
    """Tasks so that each has about `per_task` rows; no upper limit."""
    return max(least, math.ceil(rows / per_task))
