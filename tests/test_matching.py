import random

import pytest
from helpers import at, event_row, frames, greedy_exact, greedy_fuzzy, ledger_row

from tallymark.functions.ranking import number_rows
from tallymark.operators.fuzzy import match_fuzzy, pair_fuzzy
from tallymark.operators.matching import (
    find_duplicates,
    key_overlap,
    match_balances,
    match_exact,
    pair_exact,
    roll_forward,
)
from tallymark.plans.run import match, match_batch


def pairs_of(pairing):
    rows = pairing.where("l IS NOT NULL AND e IS NOT NULL").select("l.ord", "e.ord").collect()
    return sorted(tuple(r) for r in rows)


def test_exact_all_equal(spark):
    out = match_exact(*frames(spark, [ledger_row()], [event_row()]))
    assert out.matched.count() == 1
    assert out.unmatched_ledger.isEmpty() and out.unmatched_external.isEmpty()


@pytest.mark.parametrize("event", [event_row(amount="99"), event_row(reference="ref2"), event_row(asset="EUR")])
def test_exact_difference_leaves_both_open(spark, event):
    out = match_exact(*frames(spark, [ledger_row()], [event]))
    assert out.matched.isEmpty()
    assert [r.reason for r in out.unmatched_ledger.collect()] == ["no_external"]
    assert [r.reason for r in out.unmatched_external.collect()] == ["no_ledger"]


def test_exact_blank_and_missing_counterparty_agree(spark):
    out = match_exact(*frames(spark, [ledger_row(counterparty="")], [event_row(counterparty=None)]))
    assert out.matched.count() == 1


def test_exact_missing_reference_and_amount_read_as_blank_and_zero(spark):
    out = match_exact(
        *frames(spark, [ledger_row(reference="", amount="0")], [event_row(reference=None, amount=None)])
    )
    assert out.matched.count() == 1


def test_second_copy_is_the_duplicate_once(spark):
    events = [event_row(ord=i, id=f"e{i}") for i in (5, 3, 9)]
    out = match_exact(*frames(spark, [ledger_row()], events))
    assert [r.ord for r in out.duplicates.collect()] == [5]


def test_duplicates_group_nulls_and_ignore_asset(spark):
    events = [event_row(ord=1, reference=None, amount=None), event_row(ord=2, reference=None, amount=None, asset="EUR")]
    _, e = frames(spark, [], events)
    assert [r.ord for r in find_duplicates(e).collect()] == [2]


def random_exact(seed, n):
    rng = random.Random(seed)
    ref = lambda: rng.choice(["", "a", "b", None])
    amount = lambda: rng.choice(["0", "1", "2"])
    party = lambda: rng.choice(["", None, "p"])
    orders = rng.sample(range(-(1 << 45), 1 << 45), 2 * n)
    ledger = [ledger_row(o, ref() or "", "USD", amount(), party()) for o in orders[:n]]
    events = [event_row(o, reference=ref(), amount=rng.choice([None, amount()]), counterparty=party()) for o in orders[n:]]
    return ledger, events


@pytest.mark.parametrize("hot_rows", [None, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_equals_first_unused(spark, seed, hot_rows):
    """Both ways of numbering: all keys ordinary, and most of them treated as hot."""
    ledger, events = random_exact(seed, 60)
    got = pairs_of(pair_exact(*frames(spark, ledger, events), hot_rows=hot_rows))
    assert got == greedy_exact(ledger, events)


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_duplicates_come_with_the_pairing(spark, hot_rows):
    l, e = frames(spark, *random_exact(9, 60))
    found = match_exact(l, e, hot_rows).duplicates
    assert sorted(r.ord for r in found.collect()) == sorted(r.ord for r in find_duplicates(e).collect())


def test_every_row_appears_once(spark):
    ledger, events = random_exact(7, 50)
    out = match_exact(*frames(spark, ledger, events))
    assert out.matched.count() + out.unmatched_ledger.count() == 50
    assert out.matched.count() + out.unmatched_external.count() == 50
    assert out.matched.select("e.ord").distinct().count() == out.matched.count()


def test_numbering_of_hot_keys_over_many_slices(spark):
    rng = random.Random(3)
    orders = rng.sample(range(-(1 << 50), 1 << 50), 300) + list(range(1 << 21, (1 << 21) + 50))
    rows = [(("k" if i % 3 else None), o) for i, o in enumerate(orders)]
    frame = spark.createDataFrame(rows, "key string, ord bigint")
    got = {(r.key, r.ord): r.n for r in number_rows(frame, ["key"], "n", hot_rows=10).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        for n, o in enumerate(sorted(o for k, o in rows if k == key), 1):
            want[key, o] = n
    assert got == want


@pytest.mark.parametrize("gap, matched", [(60, 1), (300, 1), (301, 0), (600, 0)])
def test_fuzzy_tolerance(spark, gap, matched):
    out = match_fuzzy(*frames(spark, [ledger_row(ts=0)], [event_row(ts=gap, reference="other")]), 300)
    assert out.matched.count() == matched
    if not matched:
        assert [r.reason for r in out.unmatched_ledger.collect()] == ["no_amount_or_time"]


def test_fuzzy_unknown_time_wins_over_nearer_event(spark):
    events = [event_row(ord=1, ts=10), event_row(ord=2, ts=None), event_row(ord=3, ts=0)]
    rows = pair_fuzzy(*frames(spark, [ledger_row(ts=0)], events), 300).collect()
    assert [tuple(r) for r in rows] == [(0, 2, 10_000_000)]


def random_fuzzy(seed, n, span, null_l, null_e):
    rng = random.Random(seed)
    when = lambda share: None if rng.random() < share else rng.randrange(span)
    amount = lambda: rng.choice(["1", "1", "1", "2"])
    orders = list(range(n))
    rng.shuffle(orders)
    ledger = [ledger_row(o, amount=amount(), ts=when(null_l)) for o in orders]
    rng.shuffle(orders)
    events = [event_row(o, amount=amount(), ts=when(null_e)) for o in orders]
    return ledger, events


@pytest.mark.parametrize("null_l, null_e", [(0, 0), (0, 0.2), (0.2, 0), (0.15, 0.15), (1, 0.3), (0.3, 1)])
@pytest.mark.parametrize("chunk_rows", [10_000, 12])
def test_fuzzy_equals_serial_rule(spark, null_l, null_e, chunk_rows):
    """Small chunks force splitting, exchange between chunks and numbering."""
    ledger, events = random_fuzzy(11, 70, 9_000, null_l, null_e)
    got = pair_fuzzy(*frames(spark, ledger, events), 250, chunk_rows=chunk_rows, hot_rows=10)
    assert sorted(tuple(r) for r in got.collect()) == greedy_fuzzy(ledger, events, 250)


def test_fuzzy_dependency_chain_across_many_chunks(spark):
    """Each ledger row is pushed to the next event by the one before it."""
    n = 60
    ledger = [ledger_row(i, amount="1", ts=200 * i) for i in range(n)]
    events = [event_row(i, amount="1", ts=200 * i - 90) for i in range(1, n + 1)]
    got = pair_fuzzy(*frames(spark, ledger, events), 300, chunk_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == greedy_fuzzy(ledger, events, 300)


@pytest.mark.parametrize("seed", [3, 4])
def test_fuzzy_large_keys_with_unknown_times_on_both_sides(spark, seed):
    """Chunks by time and scans by arrival agree on one result."""
    ledger, events = random_fuzzy(seed, 60, 5_000, 0.25, 0.1)
    got = pair_fuzzy(*frames(spark, ledger, events), 250, chunk_rows=15, hot_rows=10)
    assert sorted(tuple(r) for r in got.collect()) == greedy_fuzzy(ledger, events, 250)


@pytest.mark.parametrize("null_l, null_e", [(0, 0), (0.1, 0.1)])
def test_fuzzy_chunks_much_narrower_than_the_tolerance(spark, null_l, null_e):
    """Chunks start with what is near and look further only where they must."""
    ledger, events = random_fuzzy(21, 24, 1_200, null_l, null_e)
    events = [e for e in events if e[7] is None or e[7] < at(700)]
    got = pair_fuzzy(*frames(spark, ledger, events), 3_600, chunk_rows=7, hot_rows=10)
    assert sorted(tuple(r) for r in got.collect()) == greedy_fuzzy(ledger, events, 3_600)


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_fuzzy_many_rows_at_the_same_times(spark, hot_rows):
    """Dates as times: blocks of one instant are paired by number."""
    rng = random.Random(2)
    day = lambda: 86_400 * rng.randrange(3)
    ledger = [ledger_row(o, amount="1", ts=day()) for o in rng.sample(range(500), 40)]
    events = [event_row(o, amount="1", ts=day()) for o in rng.sample(range(500), 40)]
    got = pair_fuzzy(*frames(spark, ledger, events), 300, chunk_rows=10, hot_rows=hot_rows)
    assert sorted(tuple(r) for r in got.collect()) == greedy_fuzzy(ledger, events, 300)


def test_fuzzy_accounts_for_every_row(spark):
    ledger, events = random_fuzzy(5, 40, 4_000, 0.1, 0.1)
    out = match_fuzzy(*frames(spark, ledger, events), 200)
    pairs = out.matched.count()
    assert pairs + out.unmatched_ledger.count() == 40
    assert pairs + out.unmatched_external.count() == 40


@pytest.mark.parametrize("event_amount, delta, matched", [("90", -10, False), ("100", 0, True)])
def test_roll_forward(spark, event_amount, delta, matched):
    out = match_balances(*frames(spark, [ledger_row()], [event_row(amount=event_amount)]))
    row = out.balances.first()
    assert (row.delta, row.matched, row.opening, row.source) == (delta, matched, 0, "RAILS")


def test_roll_forward_source_leftovers_and_missing_sides(spark):
    events = [
        event_row(ord=4, asset="EUR", amount="5", source="CUSTODY"),
        event_row(ord=2, asset="BTC", amount=None, source="ONCHAIN"),
    ]
    l, e = frames(spark, [ledger_row(asset="USD")], events)
    rows = roll_forward(l, e).collect()
    assert [(r.asset, r.source, r.expected_closing) for r in rows] == [("EUR", "ONCHAIN", 0)]
    out = match_balances(l, e)
    assert [r.ord for r in out.unmatched_external.collect()] == [2]
    assert out.unmatched_ledger.isEmpty()


def test_unknown_strategy_is_exact(spark):
    l, e = frames(spark, [ledger_row()], [event_row()])
    assert match(l, e, "unknown").strategy == "EXACT"
    assert match(l, e, "FUZZY").strategy == "FUZZY"
    assert match(l, e, "BALANCE_ROLLFORWARD").strategy == "BALANCE_ROLLFORWARD"


def test_batch_rows_with_float_amounts(spark):
    l = spark.createDataFrame([(1, "ref1", "USD", 100.0, "bank1")], "ord bigint, reference string, asset string, amount double, counterparty string")
    e = spark.createDataFrame([(1, "ref1", "USD", 100.0, "bank1")], "ord bigint, reference string, asset string, amount double, counterparty string")
    out = match_batch(l, e)
    assert out.matched.count() == 1
    assert key_overlap(l, e).first().ledger_rows == 1


@pytest.mark.parametrize("strategy", ["EXACT", "FUZZY", "BALANCE_ROLLFORWARD"])
def test_empty_inputs(spark, strategy):
    out = match(*frames(spark, [], []), strategy)
    for part in (out.matched, out.unmatched_ledger, out.unmatched_external, out.balances, out.duplicates):
        assert part.isEmpty()
