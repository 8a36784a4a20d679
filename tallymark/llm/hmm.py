"""A hidden Markov language model over words: Baum-Welch over partitions, exact likelihood of whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import rows_of, run_folder, settle

STATES = 8
#: Words share emission weights by hash class; the end of a text is a class of its own.
CLASSES = 1 << 15
ITERATIONS = 5
SEED = 7
#: Tokens of a block of documents, and of what is worked on at once in it.
BLOCK_TOKENS = 4_000_000
BATCH_TOKENS = 600_000
#: In training, longer texts are cut into stretches of so many tokens; scoring never cuts.
STRETCH = 512
FOLDS, HELD_OUT = 7, 2

BLOCK = "block bigint, doc_ids array<bigint>, sizes array<int>, tokens binary, words array<binary>, trained array<int>"


class _Numbers(dict):
    """A number from 1 for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def held_out(doc_id: int | None) -> bool:
    """Rows without a doc_id are learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def word_class(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of token numbers, each with its own list of words; written once.

    Words are numbered from 1 within a block, 0 is the end of a text.
    `trained` counts a word in the rows that are learnt from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
            ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("trained", pa.list_(pa.int32())),
        ])
        numbers, doc_ids, parts, total = _Numbers(), [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts], np.int32)
            learnt = np.repeat([not held_out(d) for d in doc_ids], sizes)
            trained = np.bincount(tokens[learnt], minlength=len(numbers) + 1)[1:]
            row = {"block": (partition << 24) + made, "doc_ids": doc_ids, "sizes": sizes, "tokens": tokens.tobytes(),
                   "words": list(numbers), "trained": trained.astype(np.int32)}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
                ids = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                parts.append(np.append(ids, np.uint32(0)))
                doc_ids.append(doc_id)
                total += len(parts[-1])
                if total >= BLOCK_TOKENS:
                    yield flush()
                    made, numbers, doc_ids, parts, total = made + 1, _Numbers(), [], [], 0
        if parts:
            yield flush()

    spark, place = docs.sparkSession, run_folder(docs.sparkSession, "blocks")
    docs.select("doc_id", "text").mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(BLOCK).parquet(place)


def vocabulary(table: DataFrame) -> DataFrame:
    """(block, word, c, first): each block's words with their counts in all training rows.

    `word` is the number within the block and the class (low 16 bits). A word
    has a row per block that holds it, wherever it stands in the texts, so that
    frequent words are no hot keys; `first` marks one of them.
    """
    rows = table.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "w"))
    packed = rows.selectExpr("block", "w.words AS text", "shiftleft(CAST(at + 1 AS BIGINT), 32) + w.trained AS packed")
    own = "(PARTITION BY text"
    counted = packed.selectExpr(
        "block", f"shiftleft(shiftright(packed, 32), 16) + crc32(text) % {CLASSES} AS word",
        f"sum(packed & 4294967295L) OVER {own}) AS c", f"row_number() OVER {own} ORDER BY block) = 1 AS first",
    )
    spark, place = table.sparkSession, run_folder(table.sparkSession, "vocabulary")
    counted.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(counted.schema).parquet(place)


@dataclass
class Model:
    """Log-free parameters: start (K), moves (K, K), emit (K, classes + 1)."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray

    @property
    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(64):
            p = p @ self.moves
        return p / p.sum()


def first_model(class_counts: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky moves, and the overall distribution of classes, unevenly weighted in each state."""
    rng = np.random.default_rng(seed)
    emit = (class_counts + 0.5) * np.exp(rng.normal(0, 1, (states, len(class_counts))))
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _by_time(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For each step, the places of the symbols of all sequences that last so long; sizes descend."""
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")
    for t, n in enumerate(alive.tolist()):
        yield starts[:n] + t


def log_likelihood(model: Model, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log10 probabilities of sequences by the scaled forward recursion, all in step."""
    order = np.argsort(-sizes, kind="stable")
    out, emit, moves = np.zeros(len(sizes)), model.emit, model.moves.T.copy()
    alpha = None
    for where in _by_time(classes, starts[order], sizes[order]):
        seen = emit[:, classes[where]]
        alpha = (model.start[:, None] if alpha is None else moves @ alpha[:, :len(where)]) * seen
        scale = alpha.sum(0)
        alpha /= scale
        out[:len(where)] += np.log10(scale)
    result = np.empty(len(sizes))
    result[order] = out
    return result


class Counts:
    """Expected starts, moves and emissions."""

    def __init__(self, states: int, classes: int):
        self.start, self.moves, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))

    def add(self, model: Model, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> None:
        """Forward-backward over sequences; `opening` tells which begin a text, others begin anywhere."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, opening = starts[order], sizes[order], opening[order]
        steps = list(_by_time(classes, starts, sizes))
        emit, moves = model.emit.astype(np.float32), model.moves.astype(np.float32)
        begin = np.where(opening, model.start[:, None], model.stationary[:, None]).astype(np.float32)
        alphas, seen, scales = [], [], []
        for t, where in enumerate(steps):
            e = emit[:, classes[where]]
            a = (begin if t == 0 else moves.T @ alphas[-1][:, :len(where)]) * e
            s = a.sum(0)
            a /= s
            alphas.append(a)
            seen.append(e)
            scales.append(s)
        beta = np.ones_like(alphas[-1])
        gammas = [None] * len(steps)
        gammas[-1] = alphas[-1]
        for t in range(len(steps) - 2, -1, -1):
            n, more = len(steps[t]), len(steps[t + 1])
            weighted = seen[t + 1] * beta / scales[t + 1]
            self.moves += (alphas[t][:, :more] @ weighted.T) * moves
            new = np.ones((len(moves), n), np.float32)
            new[:, :more] = moves @ weighted
            beta = new
            g = alphas[t] * beta
            gammas[t] = g / g.sum(0)
        self.start += gammas[0][:, opening].sum(1)
        symbols = classes[np.concatenate(steps)]
        gamma = np.concatenate(gammas, axis=1)
        for k in range(len(moves)):
            self.emit[k] += np.bincount(symbols, gamma[k], minlength=self.emit.shape[1])


def _split(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of sequences, long ones first, in groups of about so many tokens."""
    order = np.argsort(-sizes, kind="stable")
    group = (np.cumsum(sizes[order]) - 1) // most
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1)


def _classes_of(row: dict) -> np.ndarray:
    """The class of each token of a block."""
    own = np.fromiter((zlib.crc32(w) % CLASSES for w in row["words"]), np.int32, len(row["words"]))
    return np.concatenate([[CLASSES], own])[np.frombuffer(row["tokens"], np.uint32)]


def expectation(table: DataFrame, model: Model) -> Counts:
    """Expected counts of all blocks, added up by class in Spark; only their sums, bounded by the classes, are collected."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(model)
    states, width = model.emit.shape
    columns = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(states, width)
        for row in rows_of(batches):
            classes, sizes = _classes_of(row), np.array(row["sizes"], np.int64)
            begin = np.cumsum(sizes) - sizes
            learnt = np.array([not held_out(d) for d in row["doc_ids"]], bool)
            begin, sizes = begin[learnt], sizes[learnt]
            pieces = -(-sizes // STRETCH)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(begin, pieces) + k * STRETCH
            lengths = np.minimum(STRETCH, np.repeat(sizes, pieces) - k * STRETCH)
            for group in _split(lengths, BATCH_TOKENS):
                if len(group):
                    counts.add(shared.value, classes, starts[group], lengths[group], k[group] == 0)
        used = np.flatnonzero(counts.emit.any(0))
        # Moves and starts as rows behind the classes.
        names = np.concatenate([used, width + np.arange(states + 1)])
        sums = np.concatenate([counts.emit[:, used], counts.moves.T, counts.start[:, None]], axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *map(pa.array, sums)], ["name", *columns])

    rows = table.select("doc_ids", "sizes", "tokens", "words").mapInArrow(run, "name int, " + ", ".join(f"{c} float" for c in columns))
    out = Counts(states, width)
    for r in rows.groupBy("name").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        if r.name < width:
            out.emit[:, r.name] = r[1:]
        elif r.name < width + states:
            out.moves[:, r.name - width] = r[1:]
        else:
            out.start[:] = r[1:]
    return out


def maximisation(counts: Counts, class_counts: np.ndarray) -> Model:
    """Maximum likelihood, mixed with the distribution of all texts as often as a state shows something new."""
    prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
    emit = counts.emit + (np.minimum(counts.emit, 1).sum(1, keepdims=True) + 1) * prior
    moves, start = counts.moves + 0.1, counts.start + 0.1
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def train(table: DataFrame, class_counts: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch from a fixed start; every iteration reads all rows that are learnt from."""
    model = first_model(class_counts)
    for _ in range(iterations):
        model = maximisation(expectation(table, model), class_counts)
        settle(table.sparkSession)
    return model


def scores(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): base and model log10 probability of its tokens.

    The model: latent states move at every token; a state emits a class of
    words, and a class a word by its add-one share among the words of the class
    (one share is for all unknown words). The probability of a text is summed
    over all state sequences by the scaled forward recursion, never cut. A null
    text is empty: its end is its only token. Without any row to learn from,
    all counts are 0.
    """
    table = blocks(docs)
    words = vocabulary(table)
    settle(docs.sparkSession)
    ends = table.select(F.explode("doc_ids").alias("d")).agg(
        F.sum(F.when(F.coalesce(F.crc32(F.col("d").cast("string").cast("binary")) % FOLDS, F.lit(-1)) != HELD_OUT, 1).otherwise(0)).alias("n")
    ).first().n or 0
    per_class = words.where("first AND c > 0").groupBy((F.col("word") % (1 << 16)).alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in per_class:
        tokens[r["class"]], kinds[r["class"]] = r.n, r.v
    tokens[CLASSES], kinds[CLASSES] = ends, ends > 0
    n, v = int(tokens.sum()), int(kinds.sum())
    model = train(table, tokens, iterations)
    shared = docs.sparkSession.sparkContext.broadcast((model, tokens, kinds))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, tokens, kinds = shared.value
        out = []
        for row in rows_of(left.to_batches()):
            ids, sizes = np.frombuffer(row["tokens"], np.uint32), np.array(row["sizes"], np.int64)
            word, c = right.column("word").to_numpy(), right.column("c").to_numpy()
            count, kind = np.zeros(len(word) + 1), np.full(len(word) + 1, CLASSES)
            count[word >> 16], kind[word >> 16], count[0] = c, word & 0xFFFF, ends
            base = np.log10((count + 1) / (n + v + 1))
            share = np.log10((count + 1) / (tokens[kind] + kinds[kind] + 1))
            share[0] = 0.0  # the end is alone in its class
            begin = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x[ids], begin)  # noqa: E731, B023
            classes = kind[ids]
            score = total(share)
            for group in _split(sizes, 8 * BATCH_TOKENS):
                score[group] += log_likelihood(model, classes, begin[group], sizes[group])
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": [held_out(d) for d in row["doc_ids"]],
                "n_tokens": sizes, "n_known": total((count > 0).astype(np.int64)),
                "train_tokens": np.full(len(sizes), n, np.int64), "base_score": total(base), "score": score,
            }))
        return pa.concat_tables(out)

    return (
        table.select("block", "doc_ids", "sizes", "tokens").groupBy("block")
        .cogroup(words.select("block", "word", "c").groupBy("block"))
        .applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
                           " base_score double, score double")
    )
