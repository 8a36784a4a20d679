"""Toxicity of texts whose spelling is restored first, by a noisy channel over character lattices."""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import materialise

FOLDS, HELD_OUT = 5, 0
#: The classifier is fitted on so many labelled texts at most; language model and scores cover all.
FIT_ROWS = 200_000
#: Features are counted in so many hash buckets, and so many of them make up the model at most.
BUCKETS = 1 << 22
MODEL_ROWS = 1 << 16
PREFIXES = (4, 5, 6)
#: Tokens remembered by a worker process; then it starts anew. Results don't depend on it.
REMEMBER = 400_000

#: Letters that a sign is written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: Symbols of the language model: none of these, a to z, and the letters of Latin-1 from ß on.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SYMBOLS = len(LETTERS) + 1
#: Log-probabilities of the channel: a sign for a letter, a sign put in, a letter written twice of three or more,
#: one letter of two, a space put into a word.
SWAP, PUT_IN, DOUBLE, HALVE, SPACED = -1.0, -7.0, -0.7, -3.0, -3.0
#: Where three single letters follow each other, a space between two is rather one put in: what a boundary costs there.
SPELT = (0.0, -2.0, -4.0)
#: Words of so many letters at most may be parts of a word; the decoded rows of so many words at most are remembered.
SHORT, ROW = 3, 8
#: In a decoded row: a gap that is no word boundary.
JOINT = "\0"

_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
_SYMBOL = _CODE | {" ": 0}
_LETTERS = frozenset(_CODE)
#: The same character twice running.
_TWICE, _RUN = re.compile(r"(.)\1", re.DOTALL), re.compile(r"(.)\1+", re.DOTALL)
_TABLE = np.zeros(0x250, np.int64)
_TABLE[[ord(c) for c in LETTERS]] = np.arange(1, SYMBOLS)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def symbols(text: str) -> np.ndarray:
    """The symbol of each character of a lower-cased text, a boundary before and behind."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.concatenate([[0, 0], _TABLE[np.where(points < len(_TABLE), points, 0)], [0]])


class CharModel:
    """Interpolated trigrams of letters inside words."""

    def __init__(self, trigrams: np.ndarray):
        counts = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bigrams, single = counts.sum(0), counts.sum((0, 1))
        one = (single + 1) / (single.sum() + SYMBOLS)
        two = (bigrams + 20 * one) / (bigrams.sum(1, keepdims=True) + 20)
        self.log = np.log((counts + 20 * two) / (counts.sum(2, keepdims=True) + 20))
        #: The same as lists, which are read much faster one by one.
        self.rows = self.log.tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each stretch of a lower-cased token may stand for, with the channel's log-probability."""
    out, at = [], 0
    while at < len(token):
        sign, run = token[at], 1
        while at + run < len(token) and token[at + run] == sign:
            run += 1
        at += run
        letters = sign if sign in _CODE else LEET.get(sign, "")
        cost = 0.0 if sign in _CODE else SWAP
        ways = []
        for letter in letters:
            if run >= 3:
                ways += [(letter, cost), (letter * 2, cost + DOUBLE)]
            else:
                ways.append((letter * run, cost * run))
                if run == 2:
                    ways.append((letter, cost + HALVE))
        if sign not in _CODE:
            ways.append(("", PUT_IN if letters else 0.0))
        out.append(ways)
    return out


def decode(stretches: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The most probable way through a lattice: Viterbi by the last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    log = model.rows
    for ways in stretches:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, path) in best.items():
            for letters, cost in ways:
                x, y, q = a, b, p + cost
                if letters != JOINT:
                    for c in letters:
                        z = _SYMBOL[c]
                        q += log[x][y][z]
                        x, y = y, z
                if (x, y) not in new or new[x, y][0] < q:
                    new[x, y] = (q, (path, letters))
        best = new
    path = max(((p + log[a][b][0], path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def halve_runs(token: str, model: CharModel) -> str:
    """The most probable way through the lattice of a token that has letters of the model only.

    Such a lattice leaves open whether a run is one letter or two. Either way the state is the same two
    symbols later, so a run is decided by its neighbours alone.
    """
    log = model.rows

    def one_or_two(run: re.Match) -> str:
        at, end = run.span()
        before, letter = _CODE[token[at - 1]] if at else 0, _CODE[run[1]]
        behind = _CODE[token[end]] if end < len(token) else 0
        one = log[before][letter][behind] + (HALVE if end - at == 2 else 0.0)
        two = log[before][letter][letter] + log[letter][letter][behind] + (0.0 if end - at == 2 else DOUBLE)
        return run[1] if one > two else run[1] * 2

    return _RUN.sub(one_or_two, token)


def restore(token: str, model: CharModel) -> str:
    """The most probable spelling of a token."""
    return halve_runs(token, model) if _LETTERS.issuperset(token) else decode(lattice(token), model)


def short_core(token: str) -> str:
    """What may be part of a spaced word: the token without punctuation, if that is short."""
    core = token.strip(".,;:?\"'`´)[]{}<>*#%&~^=/\\_-").rstrip("!")
    return core if 0 < len(core) <= SHORT and any(c in _CODE or c in LEET for c in core) else ""


def has_spelling(cores: list[str]) -> bool:
    """Whether three single letters follow each other."""
    single = [len(c) == 1 for c in cores]
    return any(x and y and z for x, y, z in zip(single, single[1:], single[2:], strict=False))


def spaced_words(cores: list[str], model: CharModel, spelt: bool | None = None) -> set[str]:
    """The words that a row of short tokens spells together: each gap is a word boundary or nothing.

    If it has three single letters running, the row is decoded once more for each cost in `SPELT`, and with
    the first, the last or both of such letters taken for words of their own (a, I, y, o). For a part
    of a row, `spelt` says whether the row has them.
    """
    single = [len(c) == 1 for c in cores]
    spelt = has_spelling(cores) if spelt is None else spelt
    out = set()
    ways = [(b, False, False) for b in SPELT] + [(SPELT[-1], *x) for x in ((True, False), (False, True), (True, True))]
    for boundary, first, last in [(None, False, False), *(ways if spelt else [])]:
        stretches = lattice(cores[0])
        for k in range(1, len(cores)):
            if boundary is not None and single[k - 1] and single[k]:
                alone = first and (k == 1 or not single[k - 2]) or last and (k + 1 == len(cores) or not single[k + 1])
                stretches.append([(" ", boundary)] if alone else [(" ", boundary), (JOINT, 0.0)])
            else:
                stretches.append([(" ", 0.0), (JOINT, SPACED)])
            stretches += lattice(cores[k])
        words = (w.strip(JOINT) for w in decode(stretches, model).split(" "))
        out.update(w.replace(JOINT, "") for w in words if JOINT in w)
    return out - {""}


def is_fixed(core: str) -> bool:
    """Whether a token can only stand for itself and determines the model's state behind it."""
    return len(core) > 1 and _LETTERS.issuperset(core) and not _TWICE.search(core)


def stays_apart(left: str, right: str, model: CharModel) -> bool:
    """Whether the best way keeps a boundary between two fixed tokens, whatever stands around them.

    Every way is in the same state before such a gap and two letters behind it, so the gap is decided alone.
    """
    log, (a, b), (c, d) = model.rows, (_CODE[x] for x in left[-2:]), (_CODE[x] for x in right[:2])
    return log[a][b][0] + log[b][0][c] + log[0][c][d] > SPACED + log[a][b][c] + log[b][c][d]


def _is_odd(core: str) -> bool:
    """Whether a token has signs among its letters, or a letter twice or more running."""
    if core.isalpha():
        return _TWICE.search(core) is not None and not _LETTERS.isdisjoint(core)
    return not _LETTERS.isdisjoint(core)


def readings(token: str, model: CharModel) -> set[str]:
    """The token without signs around it, and its restored spelling if it looks obfuscated."""
    core = token.strip(".,;:?\"'`´()[]{}<>*#%&~^=/\\_-!|$@+")
    out = {core} if core else set()
    around = token.strip(".,;:?\"'`´)[]{}<>*#%&~^=/\\_-")
    # A single sign at either end may be a letter; a row of them is not.
    left, right = len(around) - len(around.lstrip("!|$@+(")), len(around) - len(around.rstrip("!|$@+("))
    around = around[left if left > 1 else 0:len(around) - (right if right > 1 or around.endswith("!") else 0)]
    if around and _is_odd(around):
        word = restore(around, model)
        if word:
            out.add(word)
    return out


def features(words: Iterable[str]) -> set[int]:
    """Buckets of whole words and of their beginnings."""
    out = set()
    for w in words:
        whole = w.encode()
        out.add(zlib.crc32(whole) % BUCKETS)
        for k in PREFIXES:
            if len(w) < k:
                break
            out.add(zlib.crc32((whole[:k] if len(whole) == len(w) else w[:k].encode()) + b"-") % BUCKETS)
    return out


class Reader:
    """Texts as numbers of tokens, and the features of each token."""

    def __init__(self, model: CharModel | None):
        self.model = model
        self.times = 0
        self.forget()

    def forget(self) -> None:
        self.times += 1
        self.codes: dict[str, int] = {}
        self.own: list[array] = []
        self.short: list[str] = []
        self.rows: dict[tuple[tuple[str, ...], bool], list[int]] = {}
        self.fixed: dict[str, bool] = {}
        self.gaps: dict[str, bool] = {}

    def add(self, token: str) -> int:
        self.codes[token] = n = len(self.codes)
        plain = token.strip(".,;:?\"'")
        if plain.isalpha() and not _TWICE.search(plain):  # nothing to restore
            self.own.append(array("i", features((plain,))))
            self.short.append(plain if len(plain) <= SHORT and any(c in _CODE for c in plain) else "")
        else:
            self.own.append(array("i", features(readings(token, self.model))))
            self.short.append(short_core(token))
        return n

    def apart(self, left: str, right: str) -> bool:
        """`stays_apart`, remembered by the four letters that decide it."""
        if left not in self.fixed:
            self.fixed[left] = is_fixed(left)
        if right not in self.fixed:
            self.fixed[right] = is_fixed(right)
        if not (self.fixed[left] and self.fixed[right]):
            return False
        key = left[-2:] + right[:2]
        if key not in self.gaps:
            self.gaps[key] = stays_apart(left, right, self.model)
        return self.gaps[key]

    def joined(self, row: list[str]) -> list[int]:
        """The words that a row of short tokens spells together.

        The row is cut where a boundary is certain, which changes no best way, and its parts are decoded.
        """
        out, at, spelt = [], 0, has_spelling(row)
        for k in range(1, len(row) + 1):
            if k == len(row) or self.apart(row[k - 1], row[k]):
                if k - at > 1:
                    out += self.part(tuple(row[at:k]), spelt)
                at = k
        return out

    def part(self, cores: tuple[str, ...], spelt: bool) -> list[int]:
        if (cores, spelt) in self.rows:
            return self.rows[cores, spelt]
        words = sorted(spaced_words(list(cores), self.model, spelt))
        out = [self.codes[w] if w in self.codes else self.add(w) for w in words]
        if len(cores) <= ROW:
            self.rows[cores, spelt] = out
        return out

    def read(self, text: str) -> list[int]:
        """The tokens of a text, and behind them the words that rows of short tokens spell together."""
        if len(self.codes) + len(self.rows) > REMEMBER:
            self.forget()
        # Millions of small objects without cycles: the collector would go through them again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            return self._read(text.lower().split())
        finally:
            if on:
                gc.enable()

    def _read(self, tokens: list[str]) -> list[int]:
        codes = self.codes
        out = list(map(codes.get, tokens))
        if None in out:
            out = [codes[t] if t in codes else self.add(t) for t in tokens]
        more, row, last = [], [], -2
        for at in compress(range(len(out)), map(self.short.__getitem__, out)):
            if at != last + 1:
                if len(row) > 1:
                    more += self.joined(row)
                row = []
            row.append(self.short[out[at]])
            last = at
        if len(row) > 1:
            more += self.joined(row)
        return out + more


_READERS: dict[int, Reader] = {}


def _reader(trigrams: np.ndarray) -> Reader:
    """This process's reader for a language model."""
    key = zlib.crc32(trigrams.tobytes())
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(CharModel(trigrams))
    return _READERS[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc_id, text or ""


def survey(docs: DataFrame) -> DataFrame:
    """(kind, a, b): trigrams and their counts (kind 0), and each text's id and copy key (kind 1).

    Texts with the same smallest hash of five words are most likely copies of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        ids, keys = [], []

        def count(text: str) -> None:
            for at in range(0, len(text), 1 << 20):
                s = symbols(text[max(0, at - 2):at + (1 << 20)])[2 if at else 0:]
                if len(s) > 2:
                    total.__iadd__(np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total)))

        waiting, chars = [], 0
        for doc_id, text in _texts(batches):
            low = text.lower()
            waiting.append(low)
            chars += len(low)
            if chars > 1 << 19:
                count("\n\n".join(waiting))
                waiting, chars = [], 0
            if doc_id is not None:
                words = np.fromiter(map(hash_word, low.split()), np.uint64)
                if len(words) > 5:
                    mixed = sum(words[k:len(words) - 4 + k] * np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(5))
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
                    keys.append(int((mixed ^ (mixed >> np.uint64(29))).min().view(np.int64)))
                else:
                    keys.append(zlib.crc32(low.encode()))
                ids.append(doc_id)
            if len(ids) >= 10_000:
                yield batch(1, ids, keys)
                ids, keys = [], []
        count("\n\n".join(waiting))
        used = np.flatnonzero(total)
        yield batch(0, used, total[used])
        yield batch(1, ids, keys)

    def batch(kind: int, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, a bigint, b bigint")


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _evidence(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """A low estimate of the share of toxic texts among those with a feature."""
    n = toxic + clean
    mean = (toxic + 2 * rate) / (n + 2)
    return mean - 2 * np.sqrt(mean * (1 - mean) / (n + 3))


def _count(docs: DataFrame, trigrams, fit, known) -> DataFrame:
    """(feature, toxic, clean): in how many of the fitted texts a feature is.

    With `known` (evidence by bucket), a toxic text counts only for the features
    that speak for it most, so that words which merely stand beside them don't;
    other texts, for which that changes nothing, are not counted again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(trigrams.value)
        ids, labels = fit.value
        toxic, clean = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            own = batch.column(0).fill_null(-1).to_numpy()
            at = np.searchsorted(ids, own).clip(max=max(0, len(ids) - 1))
            chosen = (ids[at] == own) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
            if known is not None and len(ids):
                chosen &= labels[at]
            for k in np.flatnonzero(chosen).tolist():
                codes = set(reader.read(batch.column(1)[k].as_py() or ""))
                if not codes:
                    continue
                found = np.unique(np.fromiter(chain.from_iterable(reader.own[c] for c in codes), np.int64))
                if labels[at[k]]:
                    if known is not None and len(found):
                        strength = known.value[found]
                        found = found[strength >= 0.97 * strength.max()]
                    toxic[found] += 1
                else:
                    clean[found] += 1
        used = np.flatnonzero(toxic + clean)
        for a in range(0, len(used), 1 << 16):
            u = used[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, toxic[u], clean[u])], ["feature", "toxic", "clean"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "feature bigint, toxic bigint, clean bigint")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _strongest(own: list[array], weight: np.ndarray) -> np.ndarray:
    """The weight of each token's strongest feature, 0 for a token without any."""
    sizes = np.fromiter(map(len, own), np.int64)
    out = np.zeros(len(own), np.float32)
    if sizes.any():
        weights = weight[np.fromiter(chain.from_iterable(own), np.int64)]
        out[sizes > 0] = np.maximum.reduceat(weights, (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts of all texts, and the evidence of each feature bucket.

    `labels` has doc_id and toxic; rows of the held-out fold, without an id or
    without a label are not learnt from, conflicting labels count as toxic. At
    most `FIT_ROWS` labelled texts, the first by a hash of their id, are used,
    and of texts that look like copies of each other one.
    """
    spark = docs.sparkSession
    seen = materialise(survey(docs))
    trigrams = np.zeros(SYMBOLS ** 3, np.int64)
    for r in seen.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).collect():
        trigrams[r.a] = r.n
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(learnt & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(seen.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("copy")).distinct(), "doc_id")
        .groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    rows = sorted((r.doc_id, r.toxic > 0) for r in chosen.collect())
    ids, marks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)
    rate = (marks.sum() + 0.5) / (len(marks) + 1)
    shared, fit = spark.sparkContext.broadcast(trigrams), spark.sparkContext.broadcast((ids, marks))
    known = None
    for _ in range(2):
        if known is None:
            counts = first = materialise(_count(docs, shared, fit, None))
        else:
            strongest = _count(docs, shared, fit, known).select("feature", "toxic")
            counts = materialise(strongest.join(first.select("feature", "clean"), "feature"))
        found = counts.where("toxic > 0").orderBy(F.desc(F.expr("toxic / (toxic + clean + 10)")), "feature").limit(MODEL_ROWS).collect()
        evidence = np.full(BUCKETS, 0.0, np.float32)
        at = np.array([r.feature for r in found], np.int64)
        evidence[at] = _evidence(np.array([r.toxic for r in found], float), np.array([r.clean for r in found], float), rate).clip(0, 1)
        known = spark.sparkContext.broadcast(evidence)
    return trigrams, evidence


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): held_out, score and predicted.

    The score is the evidence of the strongest feature (a restored word or its
    beginning) in the text, 0 if there is none; so for empty and null texts,
    and for all texts if nothing is labelled. Rows without a doc_id are scored.
    """
    trigrams, evidence = learn(docs, labels)
    context = docs.sparkSession.sparkContext
    shared, model = context.broadcast(trigrams), context.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weight = _reader(shared.value), model.value
        best, filled, times = np.zeros(1 << 16, np.float32), 0, reader.times
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                codes = reader.read(text or "")
                if times != reader.times:
                    filled, times = 0, reader.times
                if filled < len(reader.own):
                    while len(best) < len(reader.own):
                        best = np.concatenate([best, np.zeros_like(best)])
                    best[filled:len(reader.own)] = _strongest(reader.own[filled:], weight)
                    filled = len(reader.own)
                out.append(float(best[codes].max()) if codes else 0.0)
            ids = batch.column(0).to_pylist()
            score = np.array(out)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(score, pa.float64()),
                pa.array((score >= 0.5).astype(np.int32)),
            ], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
