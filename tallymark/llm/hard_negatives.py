"""Hard negatives by exact integer inner products, searched best first in R-trees.

Vectors are packed into pages by sort-tile-recursive: sorted by label, then by
the widest coordinate, and cut into whole pages again and again. A page carries
its minimum bounding box; upper nodes bound runs of pages. For an anchor q, a
box bounds each product q[i] * x[i] by an interval, and their sums bound every
score inside. Nodes are taken from a queue, the highest bound first; a node is
pruned if its interval lies outside the score window or strictly below the k-th
score found so far (ties at the k-th are opened, since a smaller id wins them),
or if its labels cannot serve.

Every row is indexed. Anchors are worked off in blocks of bounded size; each
block meets all pages in two passes, for positives and then, with their score
windows, for negatives. Tasks read a block from the shared folder and give out
at most k rows per anchor and window.

Whatever the input: rows with a null id, label, vector or component, or with a
component that is not finite, take no part. Every other row counts, repeated ones too;
rows with the anchor's own id are neither its positives nor its negatives.
Vectors of different lengths have no score; those of length 0 score 0.
Components and scores beyond a long count as its end. Other columns are not
read; no rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import file_system, materialise, run_folder, tasks_for

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from 30 to 90 hundredths of the positive.
LEAST, MOST = 30, 90
ANCHORS_EVERY = 100
#: Rows of a page, and children of an inner node.
PAGE_ROWS, FANOUT = 128, 16
#: Components of a tree that is packed at once, and of a block of anchors.
TREE_VALUES = BLOCK_VALUES = 1 << 20
LONG = (1 << 63) - 1

PAGE = "dims int, width int, label_low bigint, label_high bigint, ids binary, labels binary, vectors binary, low binary, high binary"
FOUND = "a bigint, positive_score bigint, score bigint, vec_id bigint"


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, dims, v) of the rows that take part; v holds floor(scale * x)."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(whole)
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.size("embedding").alias("dims"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def tiles(labels: np.ndarray, rows: np.ndarray, page: int = PAGE_ROWS) -> list[np.ndarray]:
    """Positions of the rows of each page: labels are tiled first, then the widest coordinate of each tile."""
    out, todo = [], [np.arange(len(labels))]
    while todo:
        own = todo.pop()
        if len(own) <= page:
            if len(own):
                out.append(own)
            continue
        axis = labels[own]
        if axis[0] == axis.min() == axis.max() and rows.shape[1]:
            part = rows[own].astype(np.float64)
            axis = rows[own, int(np.argmax(part.max(axis=0) - part.min(axis=0)))]
        own = own[np.argsort(axis, kind="stable")]
        half = -(-len(own) // (2 * page)) * page
        todo += [own[half:], own[:half]]
    return out


def _width(rows: np.ndarray) -> np.dtype:
    most = max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0
    return np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _pages(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    out = []
    for own in tiles(labels, rows):
        part, names = rows[own], labels[own]
        kind = _width(part)
        low, high = (part.min(axis=0), part.max(axis=0)) if part.size else (part[:0].reshape(-1), part[:0].reshape(-1))
        out.append((rows.shape[1], kind.itemsize, int(names.min()), int(names.max()), ids[own].astype("<i8").tobytes(),
                    names.astype("<i8").tobytes(), part.astype(kind).tobytes(), low.astype(kind).tobytes(), high.astype(kind).tobytes()))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = [c.split()[0] for c in PAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, rows) of runs of vectors that are equally long."""
    ids, labels, dims = (batch.column(c).to_numpy() for c in range(3))
    values = batch.column(3).flatten().to_numpy()
    upto = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
    edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield ids[a:b], labels[a:b], values[upto[a]:upto[b]].reshape(b - a, int(dims[a]))


def index(rows: DataFrame, tree_values: int = TREE_VALUES) -> DataFrame:
    """All rows as pages, a written table; ranges of (dims, label, first coordinate, id) go to tasks of even size.

    A label or a coordinate with any share of the rows is cut by what follows it.
    """
    size = rows.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    per_tree = max(PAGE_ROWS, tree_values // max(1, size.dims or 1))
    order = ["dims", "label", F.get("v", F.lit(0)), "vec_id"]
    sliced = rows.repartitionByRange(tasks_for(size.n, per_tree), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in _runs(batch):
                if held and (held[-1][2].shape[1] != part[2].shape[1] or sum(len(h[0]) for h in held) >= per_tree):
                    yield _pages(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append(part)
        if held:
            yield _pages(*map(np.concatenate, zip(*held, strict=True)))

    return materialise(sliced.select("vec_id", "label", "dims", "v").mapInArrow(run, PAGE))


class Tree:
    """Pages of one length of vectors, in the order they were packed, with their upper nodes."""

    def __init__(self, pages: list[dict]):
        self.dims = pages[0]["dims"]
        self.ids = [np.frombuffer(p["ids"], "<i8") for p in pages]
        self.labels = [np.frombuffer(p["labels"], "<i8") for p in pages]
        kinds = [np.dtype(f"<i{p['width']}") for p in pages]
        self.rows = [np.frombuffer(p["vectors"], k).reshape(len(i), self.dims) for p, k, i in zip(pages, kinds, self.ids, strict=True)]
        low, high = (np.array([np.frombuffer(p[c], k) for p, k in zip(pages, kinds, strict=True)], np.int64).reshape(len(pages), self.dims)
                     for c in ("low", "high"))
        self.largest = max([1, *(abs(int(x)) for x in (low.min(initial=0), high.max(initial=0)))])
        first, last = (np.array([p[c] for p in pages], np.int64) for c in ("label_low", "label_high"))
        self.levels = [(low, high, first, last)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.levels.append((low, high, first, last))
        self._as: dict[type, tuple] = {}

    def numbers(self, largest: int) -> type:
        """Floats where every sum of products is exact in them, else whole numbers of any size."""
        return np.float64 if self.dims * self.largest * largest < 1 << 53 else object

    def as_numbers(self, kind: type) -> tuple[list, list[np.ndarray]]:
        if kind not in self._as:
            boxes = [(low.astype(kind), high.astype(kind)) for low, high, *_ in self.levels]
            self._as[kind] = (boxes, [r.astype(kind) for r in self.rows])
        return self._as[kind]


class Best:
    """The k best (score, id) within a window of scores: higher first, then the smaller id."""

    __slots__ = ("k", "low", "high", "scores", "ids", "least")

    def __init__(self, k: int, low: int = -LONG - 1, high: int = LONG):
        self.k, self.low, self.high, self.least = k, low, high, low
        self.scores: list[int] = []
        self.ids: list[int] = []

    def wants(self, low: float, high: float) -> bool:
        """Whether scores between `low` and `high` may enter."""
        return high >= self.least and low <= self.high

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if not len(fit):
            return
        rows = sorted([*zip((-s for s in self.scores), self.ids, strict=True),
                       *zip((-int(s) for s in scores[fit]), ids[fit].tolist(), strict=True)])[:self.k]
        self.scores, self.ids = [-r[0] for r in rows], [r[1] for r in rows]
        if len(rows) == self.k:
            self.least = max(self.low, self.scores[-1])


class Query:
    """An anchor with its windows; `same` asks for rows of its label, else for all others."""

    def __init__(self, a: int, vec_id: int, label: int, v: np.ndarray, same: bool, windows: dict[int | None, Best]):
        self.a, self.vec_id, self.label, self.v, self.same, self.windows = a, vec_id, label, v, same, windows
        self.largest = max([1, *(abs(int(x)) for x in (v.min(initial=0), v.max(initial=0)))])


def search(tree: Tree, query: Query) -> int:
    """Best-first search of a tree; returns the pages it opened."""
    kind = tree.numbers(query.largest)
    q = query.v.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    boxes, rows = tree.as_numbers(kind)
    queue: list[tuple] = []
    windows, opened = list(query.windows.values()), 0

    def enter(level: int, a: int, b: int) -> None:
        _, _, first, last = tree.levels[level]
        low, high = (x[a:b] for x in boxes[level])
        most, least = (high @ up + low @ down).tolist(), (low @ up + high @ down).tolist()
        for k in range(b - a):
            f, e = first[a + k], last[a + k]
            serves = f <= query.label <= e if query.same else not f == e == query.label
            bounds = _long(least[k]), _long(most[k])
            if serves and any(w.wants(*bounds) for w in windows):
                heapq.heappush(queue, (-bounds[1], bounds[0], level, a + k))

    enter(len(tree.levels) - 1, 0, len(tree.levels[-1][0]))
    while queue:
        most, least, level, k = heapq.heappop(queue)
        if not any(w.wants(least, -most) for w in windows):
            continue
        if level:
            enter(level - 1, k * FANOUT, min((k + 1) * FANOUT, len(tree.levels[level - 1][0])))
            continue
        opened += 1
        scores, ids, labels = rows[k] @ q, tree.ids[k], tree.labels[k]
        if kind is object:
            scores = np.array([_long(s) for s in scores], object)
        fit = ((labels == query.label) if query.same else (labels != query.label)) & (ids != query.vec_id)
        scores, ids = scores[fit], ids[fit]
        if len(scores):
            top = scores.max()
            for w in windows:
                if top >= w.least:
                    w.offer(scores, ids)
    return opened


def _long(x: float) -> int:
    return min(max(int(x), -LONG - 1), LONG)


def window_of(positive: int) -> tuple[int, int]:
    """The least and the largest score s with LEAST * positive <= 100 * s <= MOST * positive."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def _table(folder: str) -> list[dict]:
    """A small written table, read in a task."""
    system, place = file_system(folder)
    return pq.read_table(place, filesystem=system).to_pylist()


def _searched(pages: DataFrame, queries: Callable[[], list[Query]]) -> DataFrame:
    """What each task finds in its pages: at most k rows per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, list[Query]] = {}
        for query in queries():
            by_dims.setdefault(len(query.v), []).append(query)
        for batch in batches:
            rows, start = batch.to_pylist(), 0
            for end in range(1, len(rows) + 1):
                if end == len(rows) or rows[end]["dims"] != rows[start]["dims"]:
                    if own := by_dims.get(rows[start]["dims"]):
                        tree = Tree(rows[start:end])
                        for query in own:
                            search(tree, query)
                    start = end
        for query in (q for own in by_dims.values() for q in own):
            out = [(query.a, p, s, i) for p, w in query.windows.items() for s, i in zip(w.scores, w.ids, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return pages.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, block_values: int = BLOCK_VALUES, tree_values: int = TREE_VALUES) -> DataFrame:
    """The best negatives of each anchor and positive, by rank.

    `rows` and `anchors` have vec_id, label, dims and v as `vectors` gives them.
    """
    spark = rows.sparkSession
    pages = index(rows, tree_values)
    size = anchors.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    blocks = tasks_for(size.n, max(1, block_values // max(1, size.dims or 1)))
    place, found = run_folder(spark, "anchors"), run_folder(spark, "negatives")
    anchors.select("vec_id", "label", "v").repartition(blocks).withColumn("block", F.spark_partition_id()).withColumn(
        "a", F.monotonically_increasing_id()).write.partitionBy("block").parquet(place)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{found}/block=-1")
    for block in range(blocks if size.n else 0):
        one = f"{place}/block={block}"
        own = spark.read.schema("vec_id bigint, a bigint").parquet(one)

        def for_positives(one: str = one) -> list[Query]:
            return [Query(r["a"], r["vec_id"], r["label"], np.array(r["v"], np.int64), True, {None: Best(POSITIVES)}) for r in _table(one)]

        best = _best(_searched(pages, for_positives), POSITIVES, "a").select("a", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
        kept = f"{run_folder(spark, 'positives')}"
        best.write.parquet(kept)

        def for_negatives(one: str = one, kept: str = kept) -> list[Query]:
            windows: dict[int, dict[int, Best]] = {}
            for r in _table(kept):
                low, high = window_of(r["positive_score"])
                if low <= high:
                    windows.setdefault(r["a"], {})[r["positive_score"]] = Best(NEGATIVES, low, high)
            return [Query(r["a"], r["vec_id"], r["label"], np.array(r["v"], np.int64), False, windows[r["a"]])
                    for r in _table(one) if r["a"] in windows]

        negatives = _best(_searched(pages, for_negatives), NEGATIVES, "a", "positive_score")
        positives = spark.read.schema("a bigint, positive_score bigint, positive_id bigint").parquet(kept)
        negatives.join(positives, ["a", "positive_score"]).join(own.withColumnRenamed("vec_id", "anchor_id"), "a").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(f"{found}/block={block}")
    return spark.read.schema(schema).parquet(found).select(*[c.split()[0] for c in schema.split(", ")])


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of `embeddings`: every hundredth id an anchor, the label of every seventh id moved on by one."""
    rows = vectors(embeddings).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHORS_EVERY == 0))


def oracle() -> str:
    return """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.rid = p.rid AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.rid, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 10"""
