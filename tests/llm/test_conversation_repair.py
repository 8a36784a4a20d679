"""Cheapest repairs against all possible ones, and against SQL."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from tallymark.llm import conversation_repair as cr

from .helpers import DATA, needs_data, run, same_as_sql

SHAPE = "conv_id bigint, turn bigint, role string, text string"


def all_repairs(rows):
    """Every way to edit rows of (initial, fault) with up to two insertions between: (cost, audit)."""
    fillings = ["", "u", "a", "ua", "au"]
    best = None
    for gaps in itertools.product(fillings, repeat=len(rows) + 1):
        for chosen in itertools.product("DKRr", repeat=len(rows)):
            if any(e != "D" and f in (1, 2) for e, (_, f) in zip(chosen, rows, strict=True)):
                continue
            shape, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
            for e, (initial, fault), gap in zip(chosen, rows, gaps[1:], strict=True):
                shape += {"D": "", "K": initial, "R": "u", "r": "a"}[e] + gap
                audit += e.upper() + "I" * len(gap)
                cost += {"D": 4, "K": 0, "R": 3, "r": 3}[e] + (3 if e != "D" and fault == 3 else 0)
            rest = shape[1:] if shape[:1] == "s" else shape
            if (not shape or rest) and rest == "ua" * (len(rest) // 2):
                best = min(best or (cost, audit), (cost, audit))
    return best


def repaired(rows):
    search, nodes, most = cr.Repair(), [], 0
    for n, (initial, fault) in enumerate(rows):
        nodes += search.step((n, initial, "x", fault), initial, fault)
        most = max(most, search.held())
    nodes += search.finish()
    return search.paid, "".join(n.letter for n in nodes), most


@pytest.mark.parametrize("seed", range(40))
def test_against_all_repairs(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaa t"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 3))]
    assert repaired(rows)[:2] == all_repairs(rows)


def plain(rows):
    """The same search with whole texts instead of a tree."""
    state = {cr.EMPTY: (0, "")}

    def better(new):
        for q, way in new:
            if q not in state or way < state[q]:
                state[q] = way

    def insert():
        better([(cr.U, (state[p][0] + 3, state[p][1] + "I")) for p in (0, 1, 3) if p in state])
        better([(cr.A, (state[cr.U][0] + 3, state[cr.U][1] + "I"))])

    insert()
    for initial, fault in rows:
        old, extra = dict(state), 3 if fault == 3 else 0
        state.clear()
        for p, (cost, audit) in old.items():
            better([(p, (cost + 4, audit + "D"))])
            if fault not in (1, 2):
                better([(cr.NEXT[p][0], (cost + 3 + extra, audit + "R"))])
                if (p, initial) in cr.KEEP:
                    better([(cr.KEEP[p, initial], (cost + extra, audit + "K"))])
        insert()
    return min(state[q] for q in (cr.EMPTY, cr.A) if q in state)


@pytest.mark.parametrize("seed", range(60))
def test_against_a_plain_search(seed):
    rng = random.Random(seed)
    initials = rng.choice(["suat", "ua", "uuua", "aaas", "sssu"])
    rows = [(rng.choice(initials), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 200))]
    assert repaired(rows)[:2] == plain(rows)


def test_long_conversations_take_little_memory():
    rng = random.Random(5)
    rows = [("ua"[k % 2] if rng.random() < 0.9 else rng.choice("suat"), rng.choice([0] * 8 + [1, 2, 3])) for k in range(20_000)]
    cost, audit, most = repaired(rows)
    assert len(audit) >= 20_000 and most < 100


@needs_data
def test_the_test_table(spark):
    same_as_sql(run(spark, "op12_conversation_repair"), cr.oracle(), {"conversations": f"{DATA}/conversations.parquet"})


def test_odd_rows(spark):
    rows = [(1, t, r, x) for t, r, x in (
        (0, "system", "Be."), (1, "user", "Ask?"), (2, "assistant", "Well."), (3, "user", "no end"), (4, None, "a."), (None, "user", None),
        (5, "", "q."), (6, "tool", "z!"), (6, "tool", "z!"), (6, "user", "q."), (9, "user", " \t\x0b"), (11, "user", "é.\x0c "))]
    rows += [(None, k, "user", "Hi.") for k in range(4)] + [(k, None, "assistant", None) for k in range(2, 40)]
    rows += [(50, k % 3, ["user", "assistant"][k % 2], "t." if k % 5 else "u") for k in range(60)]
    rows += [(60, 0, "user", "word. " * 50_000)]
    frame = spark.createDataFrame(rows, SHAPE).withColumn("fault", F.lit("x")).withColumn("gone", F.lit(True)).repartition(3)
    got = same_as_sql(cr.repaired_digests(frame), cr.oracle(), {"conversations": frame.select("conv_id", "turn", "role", "text")})
    assert len(got) == len({r[0] for r in rows})
    assert cr.repaired_digests(frame.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(7, 0, "user", "A?"), (7, 1, "user", "B."), (7, 2, "assistant", "C."), (8, 0, "assistant", " ")]
    frame = spark.createDataFrame(rows, SHAPE)
    kept = {}
    for r in cr.edits(frame).collect():
        if r.role is not None:
            kept.setdefault(r.conv_id, []).append((r.step, f"{r.role}:{r.text}"))
    assert [t for _, t in sorted(kept[7])] == ["user:A?", "assistant:", "user:B.", "assistant:C."] and 8 not in kept
    found = {r.conv_id: r for r in cr.digests(cr.edits(frame)).collect()}
    assert (found[7].cost, found[7].audit, found[7].illegal) == (3, "KIKK", 1)
    assert found[7].repaired_sha256 == hashlib.sha256(b"user:A?\nassistant:\nuser:B.\nassistant:C.").hexdigest()
    assert (found[8].cost, found[8].audit, found[8].blank) == (4, "D", 1)
