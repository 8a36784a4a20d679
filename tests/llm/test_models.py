"""The language model against enumeration and counting, toxicity on held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallymark.llm import hmm, queries, toxicity

from .helpers import DATA, DOCS, docs, needs_data, run, whole


@pytest.fixture
def model():
    rng = np.random.default_rng(0)
    return hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3))


def paths(model, seq):
    """Every state sequence with its probability."""
    for z in itertools.product(range(3), repeat=len(seq)):
        p = model.start[z[0]] * math.prod(model.moves[a, b] for a, b in itertools.pairwise(z))
        yield z, p * math.prod(model.emit[a, o] for a, o in zip(z, seq, strict=True))


SEQS = [[0], [1, 4, 2, 2, 0], [3, 3], [0, 1, 2, 3, 4, 0]]


def packed(seqs):
    sizes = np.array([len(s) for s in seqs])
    return np.concatenate(seqs), np.cumsum(sizes) - sizes, sizes


def test_forward_is_the_sum_over_all_paths(model):
    want = [math.log10(sum(p for _, p in paths(model, s))) for s in SEQS]
    assert np.allclose(hmm.log_likelihood(model, *packed(SEQS)), want, atol=1e-12)


def test_forward_of_a_very_long_text(model):
    seq = np.random.default_rng(1).integers(0, 5, 200_000)
    value = hmm.log_likelihood(model, *packed([seq, seq[:3]]))
    assert np.isfinite(value).all() and value[0] < value[1] < 0


def test_expected_counts_are_the_sum_over_all_paths(model):
    counts = hmm.Counts(3, 5)
    counts.add(model, *packed(SEQS), np.ones(len(SEQS), bool))
    want = hmm.Counts(3, 5)
    for s in SEQS:
        total = sum(p for _, p in paths(model, s))
        for z, p in paths(model, s):
            want.start[z[0]] += p / total
            for a, b in itertools.pairwise(z):
                want.moves[a, b] += p / total
            for a, o in zip(z, s, strict=True):
                want.emit[a, o] += p / total
    for name in ("start", "moves", "emit"):
        assert np.allclose(getattr(counts, name), getattr(want, name), atol=1e-4)


def test_training_raises_the_likelihood(spark):
    frame = docs(spark, *["the cat sat on the mat " * 8, "le chat est sur le tapis " * 8] * 20)
    table = hmm.blocks(frame)
    weights = np.ones(hmm.CLASSES + 1)
    values, current = [], hmm.first_model(weights, 2)
    for _ in range(4):
        row = table.first().asDict()
        classes, sizes = hmm._classes_of(row), np.array(row["sizes"])
        values.append(hmm.log_likelihood(current, classes, np.cumsum(sizes) - sizes, sizes).sum())
        current = hmm.maximisation(hmm.expectation(table, current), weights)
    assert values == sorted(values)


def counted(rows):
    learnt = [t for d, t in rows if not hmm.held_out(d)]
    counts = Counter(w for t in learnt for w in (t or "").encode().lower().split())
    counts[None] = len(learnt)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    out = {}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out.setdefault(d, []).append((hmm.held_out(d), len(w), sum(counts[x] > 0 for x in w), n, pytest.approx(base, rel=1e-9)))
    return out


def check_scores(frame, rows):
    got = {}
    for r in frame.collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:6])
        assert math.isfinite(r.score) and r.score <= 0
    want = counted(rows)
    assert got.keys() == want.keys() and all(sorted(got[d]) == want[d] if len(want[d]) == 1 else len(got[d]) == len(want[d]) for d in want)


@needs_data
def test_scores_of_the_test_table(spark):
    frame = run(spark, "op1_hmm_score").cache()
    check_scores(frame, whole(spark))
    held = frame.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    learnt = frame.where("NOT held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert learnt.s > learnt.b and held.s > 1.02 * held.b


@pytest.mark.parametrize("tokens", [4_000_000, 20])
def test_scores_of_odd_rows(spark, monkeypatch, tokens):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", tokens)
    frame = docs(spark, None, "", "A a\x1fb É é", "a " * 5000, "a b", "B\ta\nc").withColumn("block", F.lit(1))
    frame = frame.unionByName(frame.where("doc_id = 5")).unionByName(frame.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    check_scores(hmm.scores(frame, iterations=1), [(r.doc_id, r.text) for r in frame.collect()])


def test_scores_of_nothing(spark):
    docs(spark)
    assert hmm.scores(spark.createDataFrame([], DOCS), iterations=1).count() == 0


def char_model(text):
    counts = np.zeros(toxicity.SYMBOLS ** 3, np.int64)
    s = toxicity.symbols(text)
    np.add.at(counts, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    return toxicity.CharModel(counts)


ENGLISH = "what an idiot said the stupid moron to the loser and it is trash and a pathetic clown with scum in the street " * 30


@pytest.mark.parametrize("token, word", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"),
    ("$cum", "scum"), ("cl0wn!!", "clown"), ("p4th3tic", "pathetic"), ("street", "street"), ("the***", "the"),
])
def test_restored_spelling(token, word):
    assert word in toxicity.readings(token, char_model(ENGLISH))


def test_viterbi_finds_the_best_path():
    model = char_model(ENGLISH)
    for token in ["1d10t", "sss1", "aaa0", "5tr33t"]:
        best = -math.inf
        for way in itertools.product(*toxicity.lattice(token)):
            text = "".join(t for t, _ in way)
            s = toxicity.symbols(text)
            p = sum(c for _, c in way) + sum(model.log[s[i], s[i + 1], s[i + 2]] for i in range(len(s) - 2))
            if p > best:
                best, found = p, text
        assert toxicity.restore(token, model) == found


def test_spaced_letters_are_read_as_a_word():
    reader = toxicity.Reader(char_model(ENGLISH))
    assert set(reader.read("idiot")) <= set(reader.read("you i d i o t !x"))


PLAIN = "you are a man and i am the one who will say it to you so i hate the day and you hate it too yo y o é " * 30


@pytest.mark.parametrize("text, word", [
    ("you are a s t u p i d man", "stupid"), ("i h a t e you", "hate"), ("you are s t u p i d.", "stupid"), ("a st up id one", "stupid"),
    ("a stu pid one", "stupid"), ("i am a m o r o n i d i o t", "idiot"), ("i am a m o r o n i d i o t", "moron"), ("such stuupid", "stupid"),
    ("y o u, 1 d 1 0 t!", "idiot"), ("o s t u p i d", "stupid"), ("y s t u p i d é", "stupid"),
    ("i t r a s h", "trash"), ("o s c u m y", "scum"),
])
def test_spaced_words_beside_short_words(text, word):
    reader = toxicity.Reader(char_model(ENGLISH + PLAIN))
    want = set(reader.own[reader.read(word)[0]])
    assert want <= {f for c in reader.read(text) for f in reader.own[c]}


def test_short_words_stay_apart():
    reader = toxicity.Reader(char_model(ENGLISH + PLAIN))
    assert len(reader.read("you are the man and i am to say it")) == 10
    assert len(reader.read("x " * 50_000)) >= 50_000


def test_rows_are_cut_only_where_a_boundary_is_certain():
    """Cutting a row changes no word that the whole row spells."""
    rng = random.Random(5)
    model = char_model(ENGLISH + PLAIN)
    short = ["a", "i", "st", "up", "id", "is", "the", "to", "on", "all", "see", "1", "d", "o", "t", "at", "é", "dio", "ot"]
    for _ in range(3000):
        row = rng.choices(short, k=rng.randint(2, 9))
        reader = toxicity.Reader(model)
        cut = {w for c in reader.joined(row) for w, k in reader.codes.items() if k == c}
        assert cut == toxicity.spaced_words(row, model)


def test_runs_of_letters_are_decided_as_by_the_whole_lattice():
    rng = random.Random(6)
    model = char_model(ENGLISH + PLAIN)
    for _ in range(5000):
        token = "".join(c * rng.choice((1, 1, 1, 2, 3, 5)) for c in rng.choices("abdeiostué", k=rng.randint(1, 8)))
        assert toxicity.halve_runs(token, model) == toxicity.decode(toxicity.lattice(token), model)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables not present")
def test_toxic_texts_of_the_held_out_fold_are_found(spark):
    place = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{place}/labels.parquet").join(queries.QUERIES["op5_toxicity"](spark, place), "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if bool(r.toxic) == is_toxic] for is_toxic in (True, False))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean) and toxic and clean


def labelled(spark, n=400):
    plain = ["some quite harmless words number%d here" % k for k in range(n)]
    texts = [f"{t} idiot" if k % 4 == 0 else t for k, t in enumerate(plain)]
    frame = docs(spark, *texts, first=0)
    return frame, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(n)], "doc_id bigint, toxic int")


def test_toxic_texts_are_found_in_any_spelling(spark):
    frame, labels = labelled(spark)
    extra = docs(spark, "such an 1d10t", "an i d i o t again", "an idiiiiot", "nice", None, "", "x" * 100_000, first=1000)
    extra = extra.unionByName(extra.where("doc_id = 1000").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = toxicity.scores(frame.unionByName(extra).withColumn("score", F.lit(1)), labels).collect()
    found = {r.doc_id: r.predicted for r in rows}
    assert all(found[k] == int(k % 4 == 0) for k in range(400))
    assert [found[k] for k in (None, *range(1000, 1007))] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_without_labels_or_texts(spark):
    frame, labels = labelled(spark, 8)
    assert {r.predicted for r in toxicity.scores(frame, labels.limit(0)).collect()} == {0}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (2, 1)], "doc_id bigint, toxic int")
    assert toxicity.scores(frame, odd).count() == 8
    assert toxicity.scores(frame.limit(0), labels).count() == 0


@needs_data
def test_toxicity_on_held_out_rows(spark):
    rows = spark.read.parquet(f"{DATA}/labels.parquet").join(run(spark, "op5_toxicity"), "doc_id").collect()
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(rows) > 50 and sum(clean) <= 0.05 * len(clean)
