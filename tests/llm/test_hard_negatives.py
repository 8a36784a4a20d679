"""R-tree search against plain scans, and against SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallymark.llm import hard_negatives as hn
from tallymark.llm.common import ship

from .helpers import DATA, needs_data, run, same_as_sql

SHAPE = "vec_id bigint, embedding array<float>, label int"


def pages_of(ids, labels, rows):
    return hn._pages(np.array(ids, np.int64), np.array(labels, np.int64), np.array(rows, np.int64)).to_pylist()


@pytest.mark.parametrize("seed", range(25))
def test_search_against_a_scan(seed):
    rng = np.random.default_rng(seed)
    n, dims, most = int(rng.integers(1, 3000)), int(rng.integers(1, 9)), int(rng.choice([2, 50, 1 << 20, 1 << 40]))
    ids, labels = rng.permutation(n), rng.integers(0, rng.choice([1, 3, 50]) + 1, n)
    rows = rng.integers(-most, most, (n, dims))
    tree = hn.Tree(pages_of(ids, labels, rows))
    assert sorted(np.concatenate(tree.ids).tolist()) == list(range(n))
    for at in rng.integers(0, n, 8):
        for same in (True, False):
            scores = [sum(int(a) * int(b) for a, b in zip(rows[at], r, strict=True)) for r in rows]
            low, high = sorted(int(scores[i]) for i in rng.integers(0, n, 2))
            windows = {0: hn.Best(5), 1: hn.Best(10, low, high)}
            hn.search(tree, hn.Query(0, int(ids[at]), int(labels[at]), rows[at], same, windows))
            for best, (a, b) in ((windows[0], (-1 << 63, 1 << 63)), (windows[1], (low, high))):
                fit = [(-min(max(s, -1 << 63), hn.LONG), int(i)) for s, i, lab in zip(scores, ids, labels, strict=True)
                       if i != ids[at] and (lab == labels[at]) == same and a <= min(max(s, -1 << 63), hn.LONG) <= b]
                assert list(zip((-s for s in best.scores), best.ids, strict=True)) == sorted(fit)[:best.k]


def test_boxes_prune():
    """Of clustered points only the pages near the anchor are opened."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 4))
    rows = np.repeat(centres, 500, axis=0) + rng.integers(-20, 20, (20_000, 4))
    tree = hn.Tree(pages_of(range(20_000), np.zeros(20_000), rows))
    opened = [hn.search(tree, hn.Query(0, i, 0, rows[i], True, {None: hn.Best(5)})) for i in range(0, 20_000, 1000)]
    assert sum(opened) < 0.3 * len(opened) * len(tree.ids)


@pytest.mark.parametrize("positive", [-7, -1, 0, 1, 2, 3, 10, 99, 100, 101, 10**18])
def test_windows(positive):
    low, high = hn.window_of(positive)
    near = range(min(low, high) - 3, max(low, high) + 4) if positive < 10**6 else (low - 1, low, high, high + 1)
    for s in near:
        assert (30 * positive <= 100 * s <= 90 * positive) == (low <= s <= high)


@needs_data
def test_the_test_table(spark, monkeypatch):
    same_as_sql(run(spark, "op11_hard_negatives"), hn.oracle(), {"embeddings": f"{DATA}/embeddings.parquet"})


def test_small_blocks_and_trees_change_nothing(spark):
    ship(spark)
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(3)], rng.randint(0, 2)) for k in range(900)]
    frame = spark.createDataFrame(rows, SHAPE)
    vectors = hn.vectors(frame)
    anchors = vectors.where("vec_id % 100 = 0")
    whole = sorted(map(tuple, hn.hard_negatives(vectors, anchors).collect()))
    assert whole and whole == sorted(map(tuple, hn.hard_negatives(vectors, anchors, block_values=9, tree_values=600).collect()))


def brute(rows):
    """By the rules, row by row."""
    live = []
    for vec_id, v, label in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for vec_id, label, v in live:
        if vec_id % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, lab) for i, lab, w in live if i != vec_id and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted((s, i) for s, i, lab in scored if lab != label and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(vec_id, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:10])]
    return sorted(out)


def test_odd_rows(spark):
    """Nulls, not finite numbers, repeated rows and ids, ties, lengths that differ, a hot label, clashing names."""
    ship(spark)
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1.0, 0.25, 0.5, 1.0]) for _ in range(4)], 1 if k % 3 == 0 else rng.randint(0, 9)) for k in range(-200, 400)]
    rows += [(1000, None, 1), (1100, [0.5] * 4, None), (None, [0.5] * 4, 1), (1200, [None, 0.5, 0.5, 0.5], 1),
             (1300, [float("nan"), 0.5, 0.5, 0.5], 1), (1400, [float("inf"), 0.5, 0.5, 0.5], 1)]
    rows += [(100, [0.5] * 4, 3)] + [(7, [1.0] * 4, 4)] * 30 + [(500 + k, [0.5] * 2, k % 2) for k in range(20)] + [(600 + k, [], k % 3) for k in range(9)]
    frame = spark.createDataFrame(rows, SHAPE).withColumn("v", F.lit(1)).withColumn("a", F.lit(2)).repartition(3)
    got = hn.mined(frame)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert hn.mined(frame.limit(0)).count() == 0 and hn.mined(frame.where("vec_id = 100")).columns == got.columns


def test_huge_components_count_as_the_end_of_a_long(spark):
    ship(spark)
    rows = [(k, [1e30, -1e30] if k % 2 else [3e38, 1.0], k % 3) for k in range(0, 40)]
    got = hn.mined(spark.createDataFrame(rows, SHAPE)).collect()
    assert all(-hn.LONG - 1 <= r.negative_score <= hn.LONG for r in got)
