"""Token ids as Arrow files of equal-length sequences and masks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import file_system, materialise, run_folder, tasks_for
from tallymark.llm.tokens import encoder, groups

SEQUENCE = 2048
END_ID = 2
#: Sequences in a record batch, and bytes of text for a file.
BATCH_ROWS = 256
FILE_BYTES = 32 << 20


def schema(length: int, ids: pa.DataType) -> pa.Schema:
    """ids; mask: whether there is a token; ends: whether it is the last one of a document."""
    return pa.schema([
        ("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length)),
    ])


class SequenceWriter:
    """Appends documents to a file of fixed-size lists; only the last sequence may be padded."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.schema = schema(length, pa.from_numpy_dtype(dtype))
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.waiting = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Token ids of some documents and whether each is a document's last."""
        self.ids.append(ids.astype(self.dtype))
        self.ends.append(ends)
        self.waiting += len(ids)
        if self.waiting >= self.length * BATCH_ROWS:
            self._write(self.waiting // (self.length * BATCH_ROWS) * self.length * BATCH_ROWS)

    def _write(self, n: int) -> None:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        self.ids, self.ends, self.waiting = [ids[n:]], [ends[n:]], len(ids) - n
        pad = -n % self.length
        columns = [np.pad(ids[:n], (0, pad)), np.arange(n + pad) < n, np.pad(ends[:n], (0, pad))]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns]
        table = pa.Table.from_arrays([x.cast(f.type) for x, f in zip(lists, self.schema, strict=True)], schema=self.schema)
        self.writer.write_table(table, BATCH_ROWS)

    def close(self) -> None:
        if self.waiting:
            self._write(self.waiting)
        self.writer.close()


class SequenceFile:
    """Random access to a file's sequences, without copies where the file system can map files."""

    def __init__(self, path: str):
        system, place = file_system(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(place) if local else system.open_input_file(place))

    def batches(self) -> Iterator[pa.RecordBatch]:
        return map(self.reader.get_batch, range(self.reader.num_record_batches))

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """ids (a view), mask and ends of the k-th sequence; all batches but the last are full."""
        batch = self.reader.get_batch(k // BATCH_ROWS)
        ids, mask, ends = (batch.column(c)[k % BATCH_ROWS].values for c in range(3))
        return ids.to_numpy(zero_copy_only=True), mask, ends


def write_files(docs: DataFrame, folder: str, path: str, length: int = SEQUENCE, end_id: int = END_ID,
                keep_space: bool = False) -> DataFrame:
    """Writes `docs` (doc_id, text) in ascending doc_id order; one row per file: (place, file, index, n_docs, n_tokens).

    A null text is empty and has the end id only; null ids come first; rows with
    equal ids are ordered by text. Each file holds a run of documents (a range
    of ids of about 32 MB of text) and starts with a new sequence; ids are
    as narrow as the vocabulary allows. Files of one attempt of a task are its
    own, and only those of attempts that succeeded are in the result: a lost
    executor leaves files that nobody reads.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    ordered = docs.repartitionByRange(tasks_for(size, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, keep_space)
        dtype = np.dtype("uint16" if max(coder.vocabulary, end_id + 1) <= 1 << 16 else "uint32")
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        doc_type = pa.schema([("doc_id", pa.int64())])
        n_docs = n_tokens = 0
        with system.open_output_stream(f"{root}/{name}.arrow") as sink, system.open_output_stream(
            f"{root}/{name}.docs.arrow") as index_sink:
            writer, index = SequenceWriter(sink, length, dtype), pa.ipc.new_file(index_sink, doc_type)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for part in groups(texts):
                    ids, sizes = coder.encode(texts[part])
                    last = np.cumsum(sizes + 1) - 1
                    ends = np.zeros(len(ids) + len(sizes), bool)
                    ends[last] = True
                    own = np.full(len(ends), end_id, np.uint32)
                    own[~ends] = ids
                    writer.add(own, ends)
                    n_docs, n_tokens = n_docs + len(sizes), n_tokens + len(own)
                index.write_batch(pa.record_batch([batch.column(0)], schema=doc_type))
            writer.close()
            index.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{
                "place": TaskContext.get().partitionId(), "file": f"{folder}/{name}.arrow",
                "index": f"{folder}/{name}.docs.arrow", "n_docs": n_docs, "n_tokens": n_tokens,
            }], pa.schema([("place", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(ordered.mapInArrow(run, "place int, file string, index string, n_docs bigint, n_tokens bigint"))


def read_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before; the sum over files has one
    row per file. Every file is read by a task of its own, a batch at a time.
    """
    placed = manifest.selectExpr("file", "index", "sum(n_tokens) OVER (ORDER BY place) - n_tokens AS base")
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            docs = (d for b in SequenceFile(row["index"]).batches() for d in b.column(0).to_pylist())
            start, crc, n = row["base"], 0, 0
            for batch in SequenceFile(row["file"]).batches():
                ids, mask, ends = (batch.column(c).flatten() for c in range(3))
                here = ids.to_numpy(zero_copy_only=True)[mask.to_numpy(zero_copy_only=False)].astype("<u4")
                last = np.flatnonzero(ends.to_numpy(zero_copy_only=False)[mask.to_numpy(zero_copy_only=False)]) + 1
                out, at = [], 0
                for end in last.tolist():
                    crc, n = zlib.crc32(here[at:end], crc), n + end - at
                    out.append((next(docs), start, n, crc))
                    start, crc, n, at = start + n, 0, 0, end
                crc, n = zlib.crc32(here[at:], crc), n + len(here) - at
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, files), "file").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes all documents and reads them back; empty input gives no rows."""
    return read_files(write_files(docs, run_folder(docs.sparkSession, "arrow"), path))
