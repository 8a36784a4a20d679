"""First-fit decreasing against a plain scan; pieces and sequences against the tokenizer."""

import random

import pytest
from pyspark.sql import functions as F
from tallymark.llm import tournament_pack
from tallymark.llm.common import tokenizer

from .helpers import crc, docs, needs_data, run, whole
from .test_tokens import plain

FILE = "byte_bpe_50k.json"


def first_fit(sizes, capacity):
    bins, room = [], []
    for k, size in enumerate(sizes):
        at = next((b for b, r in enumerate(room) if r >= size), len(bins))
        if at == len(bins):
            bins.append([])
            room.append(capacity)
        bins[at].append(k)
        room[at] -= size
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_the_tree_finds_the_first_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 8, 100, 1024])
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 300))), reverse=True)
    assert tournament_pack.first_fit_decreasing(sizes, capacity) == first_fit(sizes, capacity)


@pytest.mark.parametrize("seed", range(60))
def test_filled_sequences_hold_every_token_once_without_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 1024])
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 200))), reverse=True)
    bins = tournament_pack.first_fit_decreasing(sizes, capacity)
    out = tournament_pack.fill_up(bins, sizes, capacity)
    assert sorted((k, at) for s in out for k, first, n in s for at in range(first, first + n)) == [
        (k, at) for k, n in enumerate(sizes) for at in range(n)]
    totals = [sum(n for *_, n in s) for s in out]
    assert all(n == capacity or n & (n - 1) == 0 for n in totals) and max(totals) <= capacity
    # Few cuts: one for each bin that was short at most, and one for each power of two.
    assert sum(map(len, out)) <= len(sizes) + len(bins) + capacity.bit_length()


def held(rows, tokens, capacity=1024):
    """Checks pieces against the ids of each document and sequences for gaps; returns the padding."""
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert parts.keys() == tokens.keys()
    for doc_id, own in parts.items():
        at, ids = 0, tokens[doc_id]
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


@needs_data
def test_the_test_table(spark):
    rows = run(spark, "op13_tournament_pack").collect()
    tokens = {doc_id: [*plain(FILE, text), 0] for doc_id, text in whole(spark)}
    assert held(rows, tokens) == 0
    rests = sum(-(-len(t) // 1024) for t in tokens.values())
    assert len(rows) <= 1.3 * rests


def test_odd_rows(spark):
    frame = docs(spark, None, "", "a", "a a " * 20_000, "b " * 1022, "b " * 1023, *["c c c"] * 30).withColumn("group", F.lit(1))
    rows = tournament_pack.packed_sequences(frame, tokenizer(FILE), most=8).collect()
    assert held(rows, {r.doc_id: [*plain(FILE, r.text), 0] for r in frame.collect()}) == 0
    assert tournament_pack.packed_sequences(frame.limit(0), tokenizer(FILE)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    """A third and more of the rows are equal: they spread over groups and are all packed."""
    base = docs(spark, "one two three " * 20, "four " * 300)
    frame = base.unionByName(base.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    frame = frame.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("n").coalesce(2)
    rows = tournament_pack.packed_sequences(frame, tokenizer(FILE), most=32).collect()
    totals = {}
    for r in rows:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    want = {1: len(plain(FILE, "one two three " * 20)) + 1, 2: len(plain(FILE, "four " * 300)) + 1}
    assert totals == {1: 400 * want[1], 2: 400 * want[2], None: 400 * want[1]}
    spread = {r.sequence_id >> 32 for r in rows if r.doc_id == 1}
    assert len(spread) > 10
    again = tournament_pack.packed_sequences(frame.repartition(7), tokenizer(FILE), most=32).collect()
    assert sum(r.length for r in again) == sum(r.length for r in rows)
