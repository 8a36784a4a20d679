from decimal import Decimal

import pytest
from helpers import T0, at, event_row, frames, ledger_row
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.scalars import age_seconds, classify_amount, classify_timing
from tallymark.operators.breaks import as_column, detect_breaks
from tallymark.operators.checks import amount_mismatches, detection_latency, new_breaks_only
from tallymark.operators.matching import match_exact
from tallymark.operators.views import latest_runs
from tallymark.plans.run import count_outcome, execute, ledger_lookback, match, reconcile


def detect(spark, ledger, events, strategy="EXACT"):
    return detect_breaks(match(*frames(spark, ledger, events), strategy), "run-1", "RAILS", T0, 300)


def test_unmatched_ledger_row_is_a_timing_gap(spark):
    row = detect(spark, [ledger_row(ts=0)], []).first()
    assert (row.type, row.classification, row.source, row.status) == ("TIMING_GAP", "TIMING", "RAILS", "OPEN")
    assert (row.internal_amount, row.external_amount, row.age_seconds) == (100, None, 0)


def test_unmatched_event_is_a_missing_entry(spark):
    row = detect(spark, [], [event_row(reference="x", source="CUSTODY")]).first()
    assert (row.type, row.classification, row.source, row.reference) == ("MISSING_ENTRY", "REAL", "RAILS", "x")
    assert (row.internal_amount, row.external_amount) == (None, 100)


def test_unbalanced_asset_is_an_amount_mismatch(spark):
    row = detect(spark, [ledger_row()], [event_row(amount="90")], "BALANCE_ROLLFORWARD").first()
    assert (row.type, row.classification, row.reference) == ("AMOUNT_MISMATCH", "REAL", None)
    assert (row.internal_amount, row.external_amount, row.source) == (100, 90, "RAILS")


def test_balanced_asset_gives_no_break(spark):
    assert detect(spark, [ledger_row()], [event_row()], "BALANCE_ROLLFORWARD").isEmpty()


def test_duplicate_that_is_also_unmatched_gives_two_breaks(spark):
    found = detect(spark, [ledger_row()], [event_row(ord=1, source="CUSTODY"), event_row(ord=2, source="CUSTODY")])
    assert sorted((r.type, r.source) for r in found.collect()) == [("DUPLICATE", "CUSTODY"), ("MISSING_ENTRY", "RAILS")]


def test_no_leftover_without_a_break_and_ids_are_stable(spark):
    ledger = [ledger_row(ord=i, reference=f"r{i}") for i in range(6)]
    events = [event_row(ord=i, reference=f"r{i}") for i in range(3, 12)]
    first, second = (detect(spark, ledger, events).collect() for _ in range(2))
    assert len(first) == 3 + 6
    assert {r.break_id for r in first} == {r.break_id for r in second}
    assert len({r.break_id for r in first}) == 9


def test_stored_amounts_keep_eight_decimals(spark):
    row = detect(spark, [ledger_row(amount="1.123456789")], []).first()
    assert row.internal_amount == Decimal("1.12345679")


@pytest.mark.parametrize("a, b, want", [(0, 60, "TIMING"), (0, 300, "TIMING"), (0, 600, "REAL"), (None, 0, "TIMING"), (0, None, "TIMING")])
def test_classify_timing(spark, a, b, want):
    frame = spark.createDataFrame([(at(a), at(b))], "a timestamp, b timestamp")
    assert frame.select(classify_timing("a", "b", 300)).first()[0] == want


@pytest.mark.parametrize("delta, want", [("5", "TIMING"), ("10", "TIMING"), ("-11", "REAL"), ("0", "TIMING"), (None, "TIMING")])
def test_classify_amount(spark, delta, want):
    value = F.lit(None if delta is None else Decimal(delta)).cast("decimal(20,6)")
    assert spark.range(1).select(classify_amount(value, 10)).first()[0] == want


@pytest.mark.parametrize("detected, now, want", [(0, 120, 120), (50, 0, 0), (0, 0.9, 0)])
def test_age(spark, detected, now, want):
    frame = spark.createDataFrame([(at(detected),)], "d timestamp")
    assert frame.select(age_seconds("d", as_column(at(now)))).first()[0] == want


def test_run_counts(spark):
    l, e = frames(
        spark,
        [ledger_row(ord=1), ledger_row(ord=2, reference="only")],
        [event_row(ord=1), event_row(ord=2, id="copy")],
    )
    row = reconcile(l, e, run_id="r", source="RAILS", started_at=T0).record.first()
    assert (row.matched_count, row.unmatched_count, row.breaks_count, row.status) == (1, 2, 3, "COMPLETED")
    row = reconcile(l, e, run_id="r", source="RAILS", strategy="BALANCE_ROLLFORWARD", started_at=T0).record.first()
    assert (row.matched_count, row.unmatched_count, row.breaks_count) == (1, 0, 0)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_counters_agree_with_and_without_pairs(spark, hot_rows):
    ledger = [ledger_row(ord=i, reference=f"r{i % 4}", counterparty="") for i in range(12)]
    events = [event_row(ord=i, reference=f"r{i % 5}" if i % 3 else None, counterparty=None) for i in range(15)]
    l, e = frames(spark, ledger, events)
    outcome = match_exact(l, e, hot_rows)
    run = reconcile(l, e, run_id="r", source="RAILS", started_at=T0)
    assert count_outcome(outcome).first() == run.counters.first()
    assert detect_breaks(outcome, "r", "RAILS", T0).count() == count_outcome(outcome).first().breaks_count


def test_execute_writes_everything_and_can_be_repeated(spark, tmp_path):
    l, e = frames(spark, [ledger_row()], [event_row(reference="other")])
    out = str(tmp_path)
    for _ in range(2):
        execute(l, e, out, run_id="r1", source="RAILS", started_at=T0)
    assert spark.read.parquet(f"{out}/breaks").count() == 2
    assert spark.read.json(f"{out}/alerts").count() == 2
    assert {r.topic for r in spark.read.json(f"{out}/audits").collect()} == {"audit.v1"}
    ended = spark.read.schema(schemas.RUN).parquet(f"{out}/runs").where("status = 'COMPLETED'").first()
    assert (ended.matched_count, ended.unmatched_count, ended.breaks_count) == (0, 2, 2)


def test_failed_run_is_recorded(spark, tmp_path):
    l, e = frames(spark, [ledger_row()], [event_row()])
    broken = e.withColumn("amount", F.raise_error(F.lit("unreadable")).cast(schemas.MATCH_MONEY))
    with pytest.raises(Exception):
        execute(l, broken, str(tmp_path), run_id="r1", source="RAILS", started_at=T0)
    states = {r.status for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert states == {"RUNNING", "FAILED"}
    status = lambda: [r.status for r in latest_runs(spark.read.parquet(f"{tmp_path}/runs")).collect()]
    assert status() == ["FAILED"]
    execute(l, e, str(tmp_path), run_id="r1", source="RAILS", started_at=T0)
    assert status() == ["COMPLETED"]
    with pytest.raises(Exception):
        execute(l, broken, str(tmp_path), run_id="r1", source="RAILS", started_at=T0)
    assert status() == ["FAILED"]


@pytest.mark.parametrize("strategy, matched", [("EXACT", 0), ("FUZZY", 1)])
def test_a_run_follows_its_rules_and_takes_its_own_events(spark, tmp_path, strategy, matched):
    rules = spark.createDataFrame(
        [("RAILS", None, strategy, 700, 60, True, "{}"), ("CUSTODY", None, "EXACT", 1, 1, True, "{}")], schemas.RULE)
    l, e = frames(spark, [ledger_row(ts=0)], [event_row(ord=1, reference="x", ts=600), event_row(ord=2, source="CUSTODY", ts=0)])
    execute(l, e, str(tmp_path), run_id="r", source="RAILS", rules=rules, started_at=T0)
    ended = spark.read.schema(schemas.RUN).parquet(f"{tmp_path}/runs").where("status = 'COMPLETED'").first()
    assert (ended.matched_count, ended.unmatched_count) == (matched, 2 - 2 * matched)


def test_lookback_includes_its_limit(spark):
    l, _ = frames(spark, [ledger_row(ord=i, ts=t) for i, t in enumerate((-301, -300, 0))], [])
    assert sorted(r.ord for r in ledger_lookback(l, T0, 300).collect()) == [1, 2]


def test_second_run_adds_no_open_break_again(spark):
    ledger, events = [ledger_row()], [event_row(reference=None, amount=None)]
    first, again = detect(spark, ledger, events), detect(spark, ledger, events)
    assert new_breaks_only(again, first).isEmpty()
    closed = first.withColumn("status", F.lit("RESOLVED"))
    assert new_breaks_only(again, closed).count() == 2


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_amount_mismatch_pairs_copies_in_order(spark, hot_rows):
    ledger = [ledger_row(ord=i, amount="100") for i in (1, 2)]
    events = [event_row(ord=i, amount=a) for i, a in ((5, "99"), (6, None), (7, "98"))]
    rows = amount_mismatches(match_exact(*frames(spark, ledger, events)), hot_rows).collect()
    assert sorted((r.l_ord, r.e_ord, r.difference) for r in rows) == [(1, 5, -1), (2, 6, -100)]


def test_latency(spark):
    _, e = frames(spark, [], [event_row(ord=i, ts=t) for i, t in enumerate((0, -50, -290, -1000, None))])
    row = detection_latency(e, F.col("ts"), as_column(T0)).first()
    assert (row.events, row.within_1_min, row.within_limit, row.over_limit, row.max_seconds) == (4, 2, 3, 1, 1000)
