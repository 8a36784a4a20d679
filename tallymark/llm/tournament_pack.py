"""Documents packed into sequences by first-fit decreasing, group by group.

A document longer than a sequence gives whole sequences and one shorter rest.
The rests are dealt to groups at random; each group is packed for itself by
first-fit decreasing, a tournament tree over the bins' free room giving the
first bin that has room. Bins that stay short are then filled up from the
emptiest ones, whose pieces are cut for it, and the one bin that is still short
is cut into powers of two, so that no sequence has to be padded.

Rows of `packed_sequences`, whatever the input:

* a null text is an empty one, which has its end id only; a null or repeated
  doc_id, and repeated rows, are documents of their own; other columns of the
  input are not read; no rows give no rows;
* a text of any length is encoded whole, a group holds at most `most` rests.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tallymark.llm.common import tasks_for
from tallymark.llm.tokens import encoder, groups

CAPACITY = 1024
END_ID = 0
#: Rests that are packed together, about.
GROUP_ROWS = 4_096
#: Sequences of one group have ids from group * 2^32 on.
ID_BITS = 32

_RESTS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, group bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: (item, first token in it, tokens)
Slice = tuple[int, int, int]


class TournamentTree:
    """Free room of bins in order; each inner node has the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for `size`, whose room then is less by it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in `sizes`, which are from 1 to `capacity` and fall."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for k, size in enumerate(sizes):
        at = tree.first(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def fill_up(bins: list[list[int]], sizes: list[int], capacity: int = CAPACITY) -> list[list[Slice]]:
    """The bins as slices of their items, all of them full or a power of two long.

    The emptiest bins are emptied into the room of the others, the fullest
    first; a cut is made only where a room ends. What the last short bin holds
    is cut into powers of two, the largest first.
    """
    out: list[list[Slice]] = []
    short: list[tuple[int, list[Slice]]] = []
    for own in bins:
        total, slices = sum(sizes[k] for k in own), [(k, 0, sizes[k]) for k in own]
        if total == capacity or total & (total - 1) == 0:
            out.append(slices)
        else:
            short.append((total, slices))
    short.sort(key=lambda b: b[0])
    giver, taker = 0, len(short) - 1
    totals, held = [b[0] for b in short], [b[1] for b in short]
    while giver < taker:
        room = capacity - totals[taker]
        while room and held[giver]:
            # The shortest slice lies last; whole slices move while they fit.
            k, first, size = held[giver].pop()
            moved = min(size, room)
            held[taker].append((k, first, moved))
            if size > moved:
                held[giver].append((k, first + moved, size - moved))
            room, totals[giver] = room - moved, totals[giver] - moved
            totals[taker] += moved
        if not room:
            out.append(held[taker])
            taker -= 1
        if not held[giver]:
            giver += 1
    if giver == taker and held[giver]:
        out += _powers(held[giver], totals[giver])
    return out


def _powers(slices: list[Slice], total: int) -> list[list[Slice]]:
    """Slices of `total` tokens as sequences of a power of two each."""
    out, waiting = [], slices[::-1]
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        own, room = [], 1 << bit
        while room:
            k, first, size = waiting.pop()
            used = min(size, room)
            own.append((k, first, used))
            if size > used:
                waiting.append((k, first + used, size - used))
            room -= used
        out.append(own)
    return out


def _cut(docs: DataFrame, path: str, capacity: int, end_id: int, keep_space: bool, buckets: int) -> DataFrame:
    """Whole sequences of long documents (ids null), and rests with their ids; each in a group of its own drawing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path, keep_space).encode, Counter()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in groups(texts):
                ids, sizes = encode(texts[part])
                out, at = [], 0
                for doc_id, n in zip(doc_ids[part], sizes.tolist(), strict=True):
                    own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at, total = at + n, n + 1
                    # Equal documents are told apart by their number in this task, so that a repeated task
                    # deals the same rows to the same groups in whatever order they come.
                    name = (doc_id, total, xxhash.xxh3_64_intdigest(own))
                    seen[name] += 1
                    draw = xxhash.xxh3_64_intdigest(f"{name}:{seen[name]}")
                    for start in range(0, total, capacity):
                        piece = own[start:start + capacity]
                        whole = len(piece) == capacity
                        out.append((doc_id, start, len(piece), zlib.crc32(piece), total, (draw + start // capacity) % buckets,
                                    None if whole else piece.tobytes()))
                types = [*[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _names(_RESTS))

    return docs.select("doc_id", "text").mapInArrow(run, _RESTS)


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _pack_group(rests: list[dict], capacity: int) -> list[list[tuple]]:
    """Sequences of (doc_id, start, length, crc, doc_tokens), each a list in order."""
    sizes = [r["length"] for r in rests]
    out = []
    for sequence in fill_up(first_fit_decreasing(sizes, capacity), sizes, capacity):
        rows = []
        for k, first, n in sequence:
            rest = rests[k]
            crc = rest["ids_crc32"] if n == rest["length"] else zlib.crc32(rest["ids"][4 * first:4 * (first + n)])
            rows.append((rest["doc_id"], rest["start"] + first, n, crc, rest["doc_tokens"]))
        out.append(rows)
    return out


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     keep_space: bool = True, most: int = GROUP_ROWS) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    `docs` has doc_id and text. Texts are encoded where they are read; only rests
    (ids of less than one sequence a document) are shuffled. A task reads its
    groups one after the other, longest rests first, and holds one at a time.
    """
    buckets = tasks_for(docs.count(), most)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, rests, out = None, 0, [], []

        def close() -> None:
            nonlocal used
            for sequence in _pack_group(rests, capacity):
                add(sequence)
            rests.clear()

        def add(sequence: list[tuple]) -> None:
            nonlocal used
            offset = 0
            for row in sequence:
                out.append((*row, (group << ID_BITS) + used, offset))
                offset += row[2]
            used += 1

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _names(PIECES))
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if group is not None:
                        close()
                    group, used = row["group"], 0
                if row["ids"] is None:
                    add([(row["doc_id"], row["start"], row["length"], row["ids_crc32"], row["doc_tokens"])])
                else:
                    rests.append(row)
                    if len(rests) >= 4 * most:
                        close()
            if len(out) >= 10_000:
                yield ready()
        if group is not None:
            close()
        if out:
            yield ready()

    order = ["group", "length", "doc_id", "start", "ids_crc32", "doc_tokens"]
    dealt = _cut(docs, path, capacity, end_id, keep_space, buckets).repartition("group")
    return dealt.sortWithinPartitions(*order, ascending=[c != "length" for c in order]).mapInArrow(pack, PIECES)
