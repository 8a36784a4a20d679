"""Near copies by 64-bit fingerprints: BK-trees over shards, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import few, materialise, tasks_for

SHINGLE = 4
RADIUS = 4
#: Bits are cut into so many blocks; two fingerprints within the radius agree in all but RADIUS of them.
BLOCKS = 6
#: A shard is never larger; larger ones are cut into slices that meet in pairs.
SHARD_ROWS = 20_000
#: Pivots that a shard may get before its tree is searched.
PIVOT_ROUNDS = 32
#: Members of shards that one task has about.
TASK_ROWS = 400_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the word shingles, as a signed number; 0 without words."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(joined)]
        hashes = [digest(view[a:b], seed) for a, b in zip(starts, ends[shingle - 1:], strict=False)]
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def shard_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """One key for each choice of blocks - radius blocks: two fingerprints within the radius share one."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("bigint")).alias("part")))
    return F.array(*keys)


class Forest:
    """BK-trees of many shards, built and searched together.

    A tree's children hang on edges that carry their distance to the parent;
    every fingerprint at distance d goes down the edge d. `shard` holds the
    number of each fingerprint's tree.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps = fps
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        edges_from, edges_d, edges_to = [], [], []
        waiting = np.arange(n)
        slot = shard.astype(np.int64)  # the place each one is on its way to
        first, index = np.unique(slot, return_index=True)
        self.root[first] = index
        parent = self.root[slot]
        waiting = waiting[parent != waiting]
        while len(waiting):
            up = parent[waiting]
            d = np.bitwise_count(fps[up] ^ fps[waiting]).astype(np.int64)
            place = up * 65 + d
            own, index, back = np.unique(place, return_index=True, return_inverse=True)
            child = waiting[index]
            edges_from.append(own // 65)
            edges_d.append(own % 65)
            edges_to.append(child)
            parent[waiting] = child[back]
            waiting = waiting[parent[waiting] != waiting]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        src, dist, to = cat(edges_from), cat(edges_d), cat(edges_to)
        order = np.lexsort((dist, src))
        self.edge_key, self.to = (src * 65 + dist)[order], to[order]

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: int, most: int = 2_000_000):
        """Batches of (query, node) pairs within the radius, following edges d-radius to d+radius only."""
        for at in range(0, len(queries), most):
            stack = [(queries[at:at + most], self.root[shard[at:at + most]])]
            while stack:
                q, node = stack.pop()
                d = np.bitwise_count(self.fps[node] ^ self.fps[q]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.edge_key, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edge_key, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                upto = np.cumsum(n)
                if not len(n) or not upto[-1]:
                    continue
                # In parts, so that memory follows `most` and not the number of pairs.
                cuts = np.searchsorted(upto, np.arange(most, upto[-1] + most, most))
                for a, b in zip([0, *(cuts[:-1] + 1)], cuts + 1, strict=True):
                    a, b = int(a), int(min(b, len(n)))
                    if a >= b:
                        continue
                    k = n[a:b]
                    inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    stack.append((np.repeat(q[a:b], k), self.to[np.repeat(low[a:b], k) + inner]))


def shard_links(fps: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of positions, that connect whatever is within the radius in each shard.

    `shard` ascends. Whatever is within the radius of a pivot, the first
    fingerprint of its shard that no earlier pivot covers, is one group and
    needs no comparison inside. All but the largest group of a shard then
    search the shard's tree, and one link for each two groups that meet is
    kept: links stay in proportion to fingerprints however dense a shard is.
    """
    n = len(fps)
    pivot, todo = np.arange(n), np.arange(n)
    for _ in range(PIVOT_ROUNDS):
        if not len(todo):
            break
        new = np.concatenate([[True], np.diff(shard[todo]) != 0])
        lead = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        near = np.bitwise_count(fps[todo] ^ fps[lead]) <= radius
        pivot[todo[near]] = lead[near]
        todo = todo[~near]
    hung = np.flatnonzero(pivot != np.arange(n))
    links = [np.stack([pivot[hung], hung])]
    size = np.bincount(pivot, minlength=n)
    order = np.lexsort((size[pivot], shard))
    last = order[np.concatenate([np.diff(shard[order]) != 0, [True]])] if n else order
    largest = np.zeros(int(shard.max()) + 1 if n else 0, np.int64)
    largest[shard[last]] = pivot[last]
    asking = np.flatnonzero(pivot != largest[shard])
    if len(asking):
        for q, node in Forest(fps, shard).within(asking, shard[asking], radius):
            a, b = np.minimum(pivot[q], pivot[node]), np.maximum(pivot[q], pivot[node])
            _, index = np.unique(a * n + b, return_index=True)
            index = index[a[index] != b[index]]
            links.append(np.stack([q[index], node[index]]))
    both = np.concatenate(links, axis=1)
    return both[0], both[1]


def near_links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): node numbers whose links join whatever is within the radius.

    `reps` has node and fp, no fingerprint twice. Shards of more than `SHARD_ROWS`
    are cut into slices, each pair of which is a shard of its own, so that no
    task holds an unbounded group; a task works on many small shards at once.
    """
    rows = reps.select("node", "fp", F.explode(shard_keys(F.col("fp"), radius=radius)).alias("k")).select("node", "fp", "k.*")
    sizes = rows.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["choice", "part"])
    slices = F.ceil(F.col("n") * 2 / SHARD_ROWS).cast("int")
    rows = rows.withColumn("s", F.when(F.col("n") > SHARD_ROWS, slices).otherwise(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    # A slice meets every other slice, and so also itself.
    rows = rows.withColumn("o", F.explode(F.expr("CASE WHEN s = 1 THEN array(0) ELSE filter(sequence(0, s - 1), x -> x <> own) END")))
    rows = materialise(rows.select("node", "fp", F.xxhash64("choice", "part", F.least("own", "o"), F.greatest("own", "o")).alias("shard")))
    tasks = tasks_for(rows.count(), TASK_ROWS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("shard", pa.int64())]))
        node, fp, shard = (table.column(c).to_numpy() for c in ("node", "fp", "shard"))
        order = np.argsort(shard, kind="stable")
        node, fp = node[order], fp[order].view(np.uint64)
        a, b = shard_links(fp, np.unique(shard[order], return_inverse=True)[1], radius)
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return rows.repartition(tasks, "shard").mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node and the smallest node it is connected with.

    Links are rewritten so that a node's larger neighbours, then its smaller
    ones, hang on its smallest; stars are left after a number of rounds that
    grows with the logarithm of the longest chain. Smallest neighbours are
    combined before the shuffle and joined back, never collected, so that a
    node with a third of all links is no burden to one task.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        """edges (u, v) of both directions or from the larger to the smaller end."""
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        met = edges.join(least, "u")
        if larger:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(least.select("u", F.col("m").alias("v")))

    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = star(both, True).where("u <> v").distinct()
        edges = materialise(star(wide, False).where("u <> v").distinct())
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): fingerprint and component.

    Equal fingerprints are one node, named after their smallest doc_id; rows
    without a doc_id take part and get the component they reach. Texts without
    words have the fingerprint zero and link like any other.
    """
    fps = materialise(fingerprints(docs))
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(near_links(reps.where("node IS NOT NULL"), radius))
    named = reps.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, all columns kept.

    Of rows with one doc_id one stays, the one whose text has the smallest hash; rows without a doc_id all stay.
    Texts are not shuffled while the ids that go are few enough to be broadcast.
    """
    found = near_duplicates(docs.select("doc_id", "text"), radius)
    found = materialise(found.select("doc_id", "component_id"))
    gone = few(found.where("doc_id <> component_id").select("doc_id").distinct())
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(gone, F.col("_id") == F.col("doc_id"), "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        order = Window.partitionBy("_id").orderBy(F.xxhash64("_row.text"))
        rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1 OR _id IS NULL")
    return rows.select("_row.*")
