"""Removal of every passage of 100 bytes that stands earlier too, over a growing family of suffix arrays.

Suffixes are sampled: the anchor of a window of 100 bytes is the place in it
whose next 37 bytes have the smallest hash. Equal windows have equal anchors,
so the suffixes of the anchors (about one in 30 bytes) miss no repeat.
Documents come in batches in the order of their ids. A batch becomes an array
of its suffixes in byte order, each with the bytes of its anchor's windows (up
to 163). The array is merged with those of the levels so far: common lengths
of neighbours tell which suffixes can share a window, and these are compared
byte by byte, earlier ones first. What is new in a batch becomes a level, and
levels of equal size are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.llm.common import rows_of, run_folder, settle, tasks_for
from tallymark.session import delete

#: Bytes of a passage, of what an anchor hashes, and the windows around an anchor (one bit each in a mask).
LENGTH = 100
KMER = 37
WINDOWS = LENGTH - KMER + 1
LEFT = WINDOWS - 1
AROUND = LEFT + LENGTH
#: Bytes of a block of documents (below what Java's collector treats as huge), and places that are hashed at once.
BLOCK_BYTES = 400_000
STEP = 1 << 18
#: The bits of a place within a step.
PLACE = np.uint64((1 << 19) - 1)
ROW_GROUP_BYTES = 4 << 20
#: Bytes of text for each bucket of the arrays.
BUCKET_BYTES = 8 << 20
#: Suffixes in a row of a level.
LEVEL_ROWS = 1 << 12
#: Bytes of blocks whose suffixes are sorted and dealt to the buckets together.
DEAL_BYTES = 8 << 20
#: Blocks that findings come to together, as a power of two.
DEAL_BITS = 4
#: Suffixes whose windows are compared at once; a passage with more surroundings is compared on its own.
HOT = 20_000
#: Suffixes whose bytes are compared with their neighbours' at once.
AROUND_ROWS = 1 << 14
#: Bytes of a batch; small inputs have four batches too, so that levels merge at any size.
BATCH_BYTES = 1 << 30
LEAST_BATCHES = 4

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 37 bytes from each place on."""
    words = data.astype(np.uint64)
    for shift in (1, 2, 4):
        words = words[:-shift] | (words[shift:] << _U(8 * shift))
    n = len(data) - KMER + 1
    out = words[:n] * _M1
    out ^= out >> _U(29)
    for at in (8, 16, 24, KMER - 8):
        out += words[at:at + n]
        out *= _M2
        out ^= out >> _U(31)
    return out


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, a power of two of them.

    Anchors are minima, so their hashes crowd at the low end; they are mixed once more before the top bits are taken.
    """
    if buckets == 1:
        return np.zeros(len(keys), np.int64)
    mixed = (keys ^ (keys >> _U(32))) * _M1
    mixed = (mixed ^ (mixed >> _U(29))) * _M2
    return (mixed >> _U(64 - (buckets - 1).bit_length())).astype(np.int64)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The smallest or largest of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents that stand one after the other: place, hash, distances from the last and first window's start.

    The windows of an anchor follow each other, and each window has one anchor, the first of its smallest
    hashes. Worked on in steps that overlap, so memory follows the step and not a document's length.
    """
    n = len(data)
    ends = np.cumsum(sizes)
    whole = np.ones(n, bool)
    short = ends[:, None] - 1 - np.arange(LENGTH - 1)
    whole[short[short >= (ends - sizes)[:, None]]] = False
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, n - LENGTH + 1, STEP):
        b = min(a + STEP, n - LENGTH + 1)
        hashes = kmer_hashes(data[a:b + LENGTH - 1])
        least = _sliding(hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64), WINDOWS, np.minimum)
        start = np.flatnonzero(whole[a:b])
        chosen = (least[start] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        place, last = chosen[first], np.append(first[1:], len(chosen))[:len(first)] - 1
        found.append((place + a, hashes[place], place - start[last], place - start[first]))
    place, key, low, high = (np.concatenate([f[k] for f in found]) for k in range(4))
    place, index = np.unique(place, return_index=True)
    if not len(place):
        return place, key, low, high
    return place, key[index], np.minimum.reduceat(low, index), np.maximum.reduceat(high, index)


class Block:
    """Some documents as one run of bytes, with their anchors."""

    def __init__(self, data: bytes, sizes: list[int]):
        self.data, self.sizes = np.frombuffer(data, np.uint8), np.array(sizes, np.int64)
        self.place, self.key, self.low, self.high = anchors(self.data, self.sizes)

    def suffixes(self) -> np.ndarray:
        """The 100 bytes from each anchor on, then the 63 before it, the nearest first; 0 outside its windows."""
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[self.place]
        out = np.concatenate([around[:, LEFT:], around[:, LEFT - 1::-1]], axis=1)
        out[:, :LENGTH] *= np.arange(LENGTH) < (LENGTH - self.low)[:, None]
        out[:, LENGTH:] *= np.arange(LEFT) < self.high[:, None]
        return out


def blocks(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """Rows of `docs` as blocks of about 400 kB, written once, apart by batch and in buckets by deal.

    A batch has the documents up to its bound, the last one the rest. A block keeps the other columns of its
    rows. Later steps bring their findings to the blocks; the texts themselves are never shuffled.
    """
    others = [c for c in docs.columns if c != "text"]
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("s")).schema["s"].dataType
    spec = f"deal bigint, block bigint, sizes array<int>, data binary, ids array<bigint>, rows array<{kind.simpleString()}>, batch int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, deals = TaskContext.get().partitionId(), 0
        texts: dict[int, list[bytes]] = {}
        rows: dict[int, list[pa.StructArray]] = {}
        total: dict[int, int] = {}
        place: dict[int, int] = {}  # block number that is next in a batch

        def flush(own: int) -> pa.RecordBatch:
            nonlocal deals
            if place.get(own, 0) % (1 << DEAL_BITS) == 0:
                place[own] = ((partition << 24) + deals) << DEAL_BITS
                deals += 1
            block = place[own]
            place[own] += 1
            struct = pa.concat_arrays(rows.pop(own))
            parts = texts.pop(own)
            del total[own]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([
                pa.array([block >> DEAL_BITS], pa.int64()), pa.array([block], pa.int64()),
                one(pa.array(map(len, parts), pa.int32())), pa.array([b"".join(parts)], pa.binary()),
                one(struct.field("doc_id").cast(pa.int64())), one(struct), pa.array([own], pa.int32()),
            ], ["deal", "block", "sizes", "data", "ids", "rows", "batch"])

        for batch in batches:
            struct = pa.StructArray.from_arrays([batch.column(c) for c in others], others)
            numbers = np.searchsorted(np.array(bounds, np.int64), _order(struct.field("doc_id").to_pylist()), "left")
            for own in np.unique(numbers).tolist():
                index = np.flatnonzero(numbers == own)
                start, column = 0, batch.column("text")
                for k, at in enumerate(index.tolist()):
                    texts.setdefault(own, []).append((column[at].as_py() or "").encode())
                    total[own] = total.get(own, 0) + len(texts[own][-1])
                    if total[own] >= BLOCK_BYTES:
                        rows.setdefault(own, []).append(struct.take(pa.array(index[start:k + 1])))
                        yield flush(own)
                        start = k + 1
                if start < len(index):
                    rows.setdefault(own, []).append(struct.take(pa.array(index[start:])))
        for own in list(texts):
            yield flush(own)

    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "texts")
    name = "texts_" + folder.rsplit("-", 1)[1]
    made = docs.mapInArrow(run, spec)
    writer = made.write.option("compression", "zstd").option("path", folder)
    # Rows are large: look at the sizes of pages and row groups after each one, so that readers hold a few rows.
    writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
    writer = writer.option("parquet.page.size.row.check.max", 4).partitionBy("batch")
    writer.bucketBy(_buckets(spark), "deal").saveAsTable(name)
    return spark.table(name)


def _buckets(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _order(ids: list) -> np.ndarray:
    """doc_ids as they are ordered; without one, before all others."""
    return np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(b"".join(a.tobytes() for a in arrays), asbytes=True)


def _unpack(blob: bytes, *parts: tuple[type, int]) -> list[np.ndarray]:
    """The arrays of a packed value, by type and length."""
    sizes = [np.dtype(kind).itemsize * n for kind, n in parts]
    raw = pa.decompress(blob, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [np.frombuffer(raw, kind, n, start) for (kind, n), start in zip(parts, starts, strict=False)]


def _texts(data: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings, which numpy compares byte by byte."""
    return np.ascontiguousarray(data).view(f"S{AROUND}").ravel()


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The mask of all windows from low to high."""
    wide = (LEFT - (high.astype(np.int64) - low)).astype(np.uint64)
    return (~_U(0) >> wide) << low.astype(np.uint64)


DEALT = "bucket bigint, n int, m int, blob binary"


def batch_suffixes(table: DataFrame, buckets: int) -> DataFrame:
    """Suffix arrays of some blocks each, in byte order, dealt to buckets by the hash of the first 37 bytes.

    A row has n different suffixes with their reach, and for each of their m places, in the order of the
    suffixes, whether it is the first of a suffix, doc_id, block and place.
    """

    def deal(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, block, at, low, high = (np.concatenate([p[k] for p in parts]) for k in range(6))
        data = np.concatenate([p[6] for p in parts])
        if not len(data):
            return
        order = np.lexsort((at, block, doc, high, low))
        bucket = buckets_of(key, buckets)
        order = order[np.argsort(_texts(data)[order], kind="stable")]
        order = order[np.argsort(bucket[order], kind="stable")]
        data, bucket, low, high = data[order], bucket[order], low[order], high[order]
        text, new = _texts(data), np.ones(len(data), bool)
        new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        named, start = np.unique(bucket, return_index=True)
        rows = []
        for own, a, b in zip(named.tolist(), start.tolist(), [*start[1:].tolist(), len(data)], strict=True):
            first, places = a + np.flatnonzero(new[a:b]), order[a:b]
            rows.append((own, len(first), b - a, _pack(
                data[first], low[first], high[first], new[a:b], doc[places], block[places], at[places].astype(np.int32))))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", "m", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for row in rows_of(batches):
            block = Block(row["data"], row["sizes"])
            doc = np.searchsorted(np.cumsum(block.sizes), block.place, "right")
            parts.append((block.key, _order(row["ids"])[doc], np.full(len(doc), row["block"]), block.place,
                          block.low.astype(np.uint8), block.high.astype(np.uint8), block.suffixes()))
            size += len(row["data"])
            if size >= DEAL_BYTES:
                yield from deal(parts)
                parts, size = [], 0
        if parts:
            yield from deal(parts)

    return table.select("block", "sizes", "data", "ids").mapInArrow(run, DEALT)


def window_masks(key: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A bit per window around each suffix: whether an earlier row with the same key has the same window.

    Rows are in order of appearance. Windows are grouped by a rolling hash and then compared byte by byte.
    """
    n = len(key)
    columns = np.ascontiguousarray(data.T)
    power = _U(pow(int(_M1), LENGTH + 1, 1 << 64))
    rolling = np.zeros(n, np.uint64)
    for j in range(LENGTH):
        rolling = (rolling + columns[j] + _U(1)) * _M1
    salt = (key.astype(np.uint64) + _U(1)) * _M2
    salt ^= salt >> _U(32)
    mask = np.zeros(n, np.uint64)
    for a in range(WINDOWS):
        o = LEFT - a
        rows = np.flatnonzero((low <= o) & (o <= high))
        h = rolling[rows]
        h = (h ^ (h >> _U(31))) * _M2 ^ salt[rows]
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        lead = rows[first[back]]
        later = lead != rows
        rows, lead = rows[later], lead[later]
        same = (key[rows] == key[lead]) & (data[rows, a:a + LENGTH] == data[lead, a:a + LENGTH]).all(1)
        for k in np.flatnonzero(~same):  # unequal windows of equal hash, if there ever are any
            own = data[rows[k], a:a + LENGTH]
            before = np.flatnonzero((key[:rows[k]] == key[rows[k]]) & (low[:rows[k]] <= o) & (o <= high[:rows[k]]))
            same[k] = bool((data[before, a:a + LENGTH] == own).all(1).any())
        mask[rows[same]] |= _U(1) << _U(o)
        if o:
            rolling = (rolling + columns[a + LENGTH] + _U(1)) * _M1 - (columns[a] + _U(1)) * power
    return mask


def merge_scan(rank: np.ndarray, old: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of suffixes in byte order, and which of them are not a copy of an earlier one.

    Only suffixes with 37 bytes in common can share a window, and a window that begins o bytes before them
    needs 100 - o in common. The longest common length of a suffix is the one with a neighbour.
    """
    mask = np.zeros(len(rank), np.uint64)
    text, alone = _texts(data), np.ones(len(rank), bool)
    alone[1:] = (text[1:] != text[:-1]) | (low[1:] < low[:-1]) | (high[1:] > high[:-1])
    mask[~alone] = _whole(low[~alone], high[~alone])
    index = np.flatnonzero(alone)
    common = np.zeros(len(index) + 1, np.int64)
    for a in range(1, len(index), AROUND_ROWS):
        own = index[a - 1:a + AROUND_ROWS]
        differ = data[own[1:], :LENGTH] != data[own[:-1], :LENGTH]
        common[a:a + len(own) - 1] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    if not len(index):
        return mask, alone
    group = np.cumsum(common[:-1] < KMER)
    least = np.maximum(low[index], LENGTH - np.maximum(common[:-1], common[1:]))
    fresh = np.bincount(group, ~old[index]) > 0
    chosen = np.flatnonzero(fresh[group] & (least <= high[index]))
    starts = np.flatnonzero(np.diff(group[chosen], prepend=-1))
    ends = np.append(starts[1:], len(chosen))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HOT, "right")))
        part = chosen[starts[a]:ends[b - 1]]
        part = part[np.argsort(rank[index[part]])]
        own = index[part]
        lines = np.concatenate([data[own, :LENGTH - 1:-1], data[own, :LENGTH]], axis=1)
        mask[own] = window_masks(group[part], least[part], high[own], lines)
        a = b
    return mask, alone


class SuffixFamily:
    """Levels of suffix arrays, each of a power of two of batches, in one table in buckets.

    A level has the suffixes of its batches in byte order, each with a window that no earlier one has. Adding
    a batch reads every level once, bucket by bucket where it is stored; only the batch is shuffled.
    """

    ROW = "bucket bigint, deal bigint, part int, n int, blob binary, level int"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, run_folder(spark, "suffixes")
        self.name = "suffixes_" + self.folder.rsplit("-", 1)[1]
        self.levels: list[tuple[int, int]] = []
        self.added = 0

    def add(self, batch: DataFrame, keep: bool = True) -> None:
        """Finds what the batch repeats and, with `keep`, makes it a level, merged with those of equal size."""
        size, merged = 1, 0
        while keep and merged < len(self.levels) and self.levels[-1 - merged][0] == size:
            size, merged = size * 2, merged + 1
        stay, gone = self.levels[:len(self.levels) - merged], {k for _, k in self.levels[len(self.levels) - merged:]}
        self.added += 1
        level, finding = self.added, -self.added
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        names = [x.split()[0] for x in self.ROW.split(", ")]

        def scan(new: pa.Table, old: pa.Table) -> pa.Table:
            out, parts, joins, many = [], [], [], []
            for r in sorted(old.to_pylist(), key=lambda r: (r["level"], r["part"])):
                n = r["n"]
                data, low, high = _unpack(r["blob"], (np.uint8, n * AROUND), (np.uint8, n), (np.uint8, n))
                parts.append((data.reshape(n, AROUND), low, high))
                joins.append(np.full(n, r["level"] in gone))
            before = sum(map(len, joins))
            owners, others = [], []
            for r in new.to_pylist():
                n, m = r["n"], r["m"]
                data, low, high, first, doc, block, at = _unpack(
                    r["blob"], (np.uint8, n * AROUND), (np.uint8, n), (np.uint8, n), (bool, m), (np.int64, m), (np.int64, m), (np.int32, m))
                parts.append((data.reshape(n, AROUND), low, high))
                owners.append((doc[first], block[first], at[first]))
                copy = (np.cumsum(first) - 1)[~first]
                others.append((block[~first], at[~first], _whole(low[copy], high[copy])))
            if parts:
                data, low, high = (np.concatenate([p[k] for p in parts]) for k in range(3))
                del parts
                rank = np.arange(len(data))
                doc, block, at = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in owners)]) for k in range(3))
                rank[before:][np.lexsort((at, block, doc))] = before + np.arange(len(doc))
                order = np.argsort(rank)
                order = order[np.argsort(_texts(data)[order], kind="stable")]
                data, low, high, rank = data[order], low[order], high[order], rank[order]
                mask, alone = merge_scan(rank, order < before, low, high, data)
                if keep:
                    stays = np.concatenate([*joins, np.ones(len(doc), bool)])[order]
                    many = np.flatnonzero(stays & ((order < before) | (alone & (mask != _whole(low, high)))))
                batch_rows = np.flatnonzero((order >= before) & (mask != 0))
                own = order[batch_rows] - before
                others.append((block[own], at[own], mask[batch_rows]))
                block, at, bits = (np.concatenate([o[k] for o in others]) for k in range(3))
                by = np.lexsort((at, block))
                block, at, bits = block[by], at[by].astype(np.int32), bits[by]
                bucket = (new if new.num_rows else old).column("bucket")[0].as_py()
                deals, start = np.unique(block >> DEAL_BITS, return_index=True)
                for own, a, b in zip(deals.tolist(), start.tolist(), [*start[1:].tolist(), len(block)], strict=False):
                    out.append((bucket, own, None, b - a, _pack(block[a:b], at[a:b], bits[a:b]), finding))
                for k, a in enumerate(range(0, len(many), LEVEL_ROWS)):
                    part = many[a:a + LEVEL_ROWS]
                    out.append((bucket, None, k, len(part), _pack(data[part], low[part], high[part]), level))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, kinds, strict=True)})

        found = batch.groupBy("bucket").cogroup(self._rows([k for _, k in self.levels]).groupBy("bucket")).applyInArrow(scan, self.ROW)
        writer = found.write.mode("append").option("path", self.folder).option("compression", "none").partitionBy("level")
        writer.bucketBy(_buckets(self.spark), "bucket").saveAsTable(self.name)
        if keep:
            self._drop(gone)
            self.levels = [*stay, (size, level)]

    def _rows(self, levels: list[int]) -> DataFrame:
        if not levels:
            return self.spark.createDataFrame([], self.ROW)
        return self.spark.table(self.name).where(F.col("level").isin(levels))

    def _drop(self, levels: Iterable[int]) -> None:
        for level in levels:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (level = {level})")
            delete(self.spark, f"{self.folder}/level={level}")

    def findings(self) -> DataFrame:
        """(deal, n, blob): blocks, places and masks of what was found; the levels are dropped."""
        self._drop(k for _, k in self.levels)
        self.levels = []
        return self.spark.table(self.name).where("level < 0").select("deal", "n", "blob")


def _per_block(table: DataFrame, findings: DataFrame, work, spec: str, columns: list[str]) -> DataFrame:
    """`work(row, places, masks)` for each block, which stays where it is stored."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [_unpack(r["blob"], (np.int64, r["n"]), (np.int32, r["n"]), (np.uint64, r["n"])) for r in right.to_pylist()]
        block, at, mask = (np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate((np.int64, np.int32, np.uint64)))
        order = np.argsort(block, kind="stable")
        block, at, mask = block[order], at[order], mask[order]
        parts = [empty]
        for row in rows_of(left.to_batches()):
            own = slice(*np.searchsorted(block, [row["block"], row["block"] + 1]).tolist())
            parts.append(work(row, at[own], mask[own]))
        return pa.concat_tables(parts)

    empty = work(None, None, None)
    return table.select("deal", "block", *columns).groupBy("deal").cogroup(findings.groupBy("deal")).applyInArrow(run, spec)


def _removed(row: dict, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block, where its documents end, and which bytes a passage covers that stands earlier too."""
    data = np.frombuffer(row["data"], np.uint8)
    starts = np.zeros(len(data), bool)
    for o in range(WINDOWS):
        starts[at[(mask >> _U(o)) & _U(1) == 1] - o] = True
    count = np.concatenate([np.zeros(LENGTH, np.int64), np.cumsum(starts)])
    return data, np.cumsum(row["sizes"]), count[LENGTH:] > count[:-LENGTH]


def repeats(docs: DataFrame, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks of `docs`, and by deal where windows around a place repeat an earlier one (a bit each)."""
    spark = docs.sparkSession
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    batches = batches or tasks_for(size, BATCH_BYTES, LEAST_BATCHES)
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), shares).alias("b")).first().b if shares else []
    table = blocks(docs, sorted(bounds or []))
    buckets = 1 << (tasks_for(size, BUCKET_BYTES) - 1).bit_length()
    family = SuffixFamily(spark)
    for k in range(batches):
        family.add(batch_suffixes(table.where(F.col("batch") == k), buckets), keep=k + 1 < batches)
        settle(spark)
    return table, family.findings()


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def repeat_digests(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): bytes, bytes removed, runs removed, and a hash of what is left.

    A null text is empty; a row without doc_id comes before all others; of
    rows with one doc_id, the one that is stored first. A text of less than 100
    bytes is left as it is. Empty input gives no rows.
    """

    def digest(row: dict | None, at: np.ndarray | None, mask: np.ndarray | None) -> pa.Table:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()]
        out = []
        if row is not None:
            every, ends, gone = _removed(row, at, mask)
            for doc_id, end, size in zip(row["ids"], ends.tolist(), row["sizes"], strict=True):
                own, data = gone[end - size:end], every[end - size:end]
                runs = int(own[:1].sum()) + int((np.diff(own.astype(np.int8)) == 1).sum())
                out.append((doc_id, size, int(own.sum()), runs, hashlib.sha256(data[~own].tobytes()).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    table, findings = repeats(docs.select("doc_id", "text"), batches)
    return _per_block(table, findings, digest, DIGEST, ["sizes", "data", "ids"])


def without_repeats(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """All rows and columns of `docs`, the repeated passages taken out of `text` (and `n_chars` set anew).

    Where a run of bytes begins or ends inside a character, the rest of that
    character goes too. Rows stay even if nothing is left of their text.
    """
    columns = docs.columns
    kinds = {f.name: f.dataType for f in docs.schema}

    def cleaned(row: dict | None, at: np.ndarray | None, mask: np.ndarray | None) -> pa.Table:
        texts, others = [], []
        if row is not None:
            data, ends, gone = _removed(row, at, mask)
            for end, size in zip(ends.tolist(), row["sizes"], strict=True):
                texts.append(data[end - size:end][~gone[end - size:end]].tobytes().decode("utf-8", "ignore"))
            others = row["rows"]
        values = {c: [r[c] for r in others] for c in columns if c not in ("text", "n_chars")} | {"text": texts}
        if "n_chars" in columns:
            values["n_chars"] = list(map(len, texts))
        return pa.table({c: pa.array(values[c], arrow[c]) for c in columns})

    arrow = {c: to_arrow_type(k) for c, k in kinds.items()}
    table, findings = repeats(docs, batches)
    fields = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in columns)
    return _per_block(table, findings, cleaned, fields, ["sizes", "data", "ids", "rows"])
