"""Documents packed into few sequences: provably good bins first, best fit for what is left."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import materialise, tasks_for
from tallymark.llm.tokens import encoder, groups

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are numbered in buckets of about so many.
BUCKET_ROWS = 50_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole, or full pieces behind a shorter first one."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_space: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; `with_ids` adds the ids themselves.

    `docs` has doc_id and text. A null text is empty and has the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keep_space).encode
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in groups(texts):
                ids, sizes = encode(texts[part])
                out, blobs, at = [], [], 0
                for doc_id, n in zip(doc_ids[part], sizes.tolist(), strict=True):
                    own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at, start = at + n, 0
                    for k, length in enumerate(cut(n + 1, capacity)):
                        blob = own[start:start + length].tobytes()
                        out.append((doc_id, k, start, length, zlib.crc32(blob)))
                        if with_ids:
                            blobs.append(blob)
                        start += length
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


Pattern = list[tuple[int, int]]


class _Lengths:
    """How many pieces there are of each length, with quick neighbours."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.remove(length)

    def largest(self, most: int) -> int | None:
        at = bisect_left(self.order, most + 1)
        return self.order[at - 1] if at else None

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for length in self.order:
            out += [length] * min(n - len(out), self.left[length])
            if len(out) == n:
                break
        return out

    def best_pair(self, most: int) -> int:
        """The largest sum of two different pieces that is at most `most`; 0 if none."""
        best, low, high = 0, 0, len(self.order) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if a + b > most or (low == high and self.left[a] < 2):
                high -= 1
            else:
                best, low = max(best, a + b), low + 1
        return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Bins that some best packing has, as (pattern, how many), and the lengths that are left.

    From long to short, a piece and the longest that fits beside it are a bin
    for good if they dominate every other filling: if they fill the bin, if at
    most one piece fits beside it, or if no three fit and no two together are
    longer than that one. A piece beside which nothing fits is a bin alone.
    """
    lengths, bins = _Lengths(counts), []
    for j in sorted(counts, reverse=True):
        while lengths.left.get(j):
            n = lengths.left[j]
            lengths.take(j, 1)
            k = lengths.largest(capacity - j)
            if k is None:
                lengths.left[j] = lengths.left.get(j, 0)
                if lengths.left[j]:
                    lengths.take(j, n - 1)
                else:
                    del lengths.left[j]
                bins.append(([(j, 1)], n))
                continue
            few = lengths.smallest(3)
            room = capacity - j
            sure = (
                k == room
                or len(few) < 2 or few[0] + few[1] > room
                or ((len(few) < 3 or sum(few) > room) and lengths.best_pair(room) <= k)
            )
            if not sure:
                if j in lengths.left:
                    lengths.left[j] += 1
                else:
                    lengths.left[j] = 1
                    insort(lengths.order, j)
                break
            # As many at once as the same reasoning holds for: only full bins repeat it unchanged.
            times = 1 if k != room else (min(n, lengths.left[k]) if k != j else n // 2)
            if j == k:
                lengths.take(j, 2 * times - 1)
                bins.append(([(j, 2)], times))
            else:
                if times > 1:
                    lengths.take(j, times - 1)
                lengths.take(k, times)
                bins.append(([(j, 1), (k, 1)], times))
    return _merged(bins), dict(lengths.left)


def _merged(bins: list[tuple[Pattern, int]]) -> list[tuple[Pattern, int]]:
    out: dict[tuple, int] = {}
    for pattern, n in bins:
        out[tuple(pattern)] = out.get(tuple(pattern), 0) + n
    return [(list(p), n) for p, n in out.items()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing length, equal bins together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, [(length, each)], n // each)
                if n % each:
                    put(capacity - n % each * length, [(length, n % each)], 1)
                break
            room = rooms[at]
            pattern, bins = open_bins[room].pop()
            each = min(room // length, n)
            used = min(bins, n // each)
            put(room - each * length, [*pattern, (length, each)], used)
            if bins > used:
                put(room, pattern, bins - used)
            if not open_bins[room]:
                del open_bins[room]
                rooms.remove(room)
            n -= used * each
    return [x for room in rooms for x in open_bins[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, pieces in a bin, offset), by rank.

    The size of the plan depends on the capacity, not on the number of documents.
    """
    fixed, rest = reduce_instance(counts, capacity)
    rank = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    first = 0
    for pattern, n in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, each in pattern:
            rows[length].append((rank[length], first, each, offset))
            rank[length] += each * n
            offset += each * length
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items() if v}


def _ranked(rows: DataFrame) -> DataFrame:
    """`rows` plus rank: from 0 within the length, without any task having all pieces of a length."""
    buckets = tasks_for(rows.count(), BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).selectExpr(
        "length", "bucket", "sum(n) OVER (PARTITION BY length ORDER BY bucket ROWS UNBOUNDED PRECEDING) - n AS before"
    )
    numbered = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) - 1 AS own"
    )
    return numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`rows` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    Only the number of pieces of each length (at most `capacity` numbers) comes
    to the driver, where bins are planned; each piece then finds its place by its
    rank among the pieces of its length. Empty input gives no rows.
    """
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = rows.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = places.value[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                k = rank[own] - row[:, 0]
                bins[own], offset[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(bins), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    return _ranked(rows).select(*columns, "rank").mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    `docs` has doc_id and text (null: empty). Repeated rows are packed each for itself.
    """
    return pack(materialise(pieces(docs, path, capacity)), capacity)
