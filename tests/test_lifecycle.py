import json
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from helpers import T0, at, break_row, breaks_frame, commands_frame, event_row, events_frame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import events as ev
from tallymark.operators import lifecycle as lc
from tallymark.operators import rules as rl


def test_ages_of_open_breaks_only(spark):
    breaks = breaks_frame(
        spark, break_row("a", detected=-120), break_row("b", detected=-60, age=60),
        break_row("c", status="RESOLVED", detected=-60),
    )
    assert [(r.break_id, r.age_seconds) for r in lc.update_ages(breaks, T0).collect()] == [("a", 120)]


def test_stale_break_escalates_with_one_alert_and_one_audit(spark):
    breaks = breaks_frame(spark, break_row("old", detected=-7200, age=5), break_row("new", detected=-30))
    moved = lc.escalate_stale(breaks, T0, 60)
    assert [(r.break_id, r.status, r.age_seconds) for r in moved.collect()] == [("old", "ESCALATED", 7200)]
    alert = lc.alerts_of(moved).collect()
    assert [(a.break_id, a.action, a.actor, a.age_seconds) for a in alert] == [("old", "escalated", "system", 7200)]
    audit = lc.audits_of(moved).first()
    assert (audit.before.status, audit.before.age_seconds) == ("OPEN", 5)
    assert (audit.after.status, audit.after.age_seconds) == ("ESCALATED", 7200)


def test_exactly_at_the_age_limit_escalates(spark):
    breaks = breaks_frame(spark, break_row("a", detected=-3600), break_row("b", detected=-3599))
    assert [r.break_id for r in lc.escalate_stale(breaks, T0, 60).collect()] == ["a"]


def test_cycle_ages_and_escalates_in_one_state(spark):
    breaks = breaks_frame(spark, break_row("a", detected=-7200), break_row("b", detected=-30), break_row("c", status="RESOLVED"))
    state = lc.apply_to(breaks, lc.age_and_escalate(breaks, T0, 60)).collect()
    assert sorted((r.break_id, r.status, r.age_seconds) for r in state) == [
        ("a", "ESCALATED", 7200), ("b", "OPEN", 30), ("c", "RESOLVED", 0)]


def test_manual_escalation(spark):
    breaks = breaks_frame(spark, break_row("a", status="RESOLVED", detected=-10))
    commands = commands_frame(spark, ("a", "ann", "look", 1), ("missing", "ann", None, 2))
    moved = lc.escalate_manually(breaks, commands, T0)
    row = moved.first()
    assert moved.count() == 1
    assert (row.status, row.before_status, row.age_seconds) == ("ESCALATED", "RESOLVED", 10)
    assert [(r.type, r.actor, r.note) for r in lc.resolutions_of(moved).collect()] == [("MANUAL", "ann", "look")]
    assert lc.alerts_of(moved).first().actor == "ann"
    assert [r.break_id for r in lc.unknown_commands(breaks, commands).collect()] == ["missing"]


def test_two_commands_on_one_break_leave_two_rows_and_one_state(spark):
    breaks = breaks_frame(spark, break_row("a"))
    commands = commands_frame(spark, ("a", "ann", None, 1), ("a", "bob", None, 2))
    moved = lc.resolve_manually(breaks, commands, T0)
    assert sorted((r.actor, r.before_status) for r in moved.collect()) == [("ann", "OPEN"), ("bob", "RESOLVED")]
    assert lc.new_state(moved).count() == 1
    assert lc.resolutions_of(moved).count() == 2


def test_resolution_time_is_stamped_once(spark):
    breaks = breaks_frame(spark, break_row("a"), break_row("b", status="RESOLVED", resolved=-99))
    moved = lc.resolve_manually(breaks, commands_frame(spark, ("a", "x", None, 1), ("b", "x", None, 2)), T0)
    got = {r.break_id: r.resolved_at for r in moved.select("break_id", F.unix_micros("resolved_at").alias("resolved_at")).collect()}
    assert got["a"] - got["b"] == 99_000_000


def test_status_update_keeps_age_when_none_is_given(spark):
    breaks = breaks_frame(spark, break_row("a", age=7), break_row("b", age=7))
    changes = spark.createDataFrame(
        [(3, "a", "CLOSED", None), (2, "b", "OPEN", 9), (1, "b", "CLOSED", 8), (2, "a", "OPEN", 5)],
        "ord bigint, break_id string, new_status string, new_age bigint")
    rows = {r.break_id: r for r in lc.set_status(breaks, changes, T0).collect()}
    assert (rows["a"].age_seconds, rows["b"].age_seconds) == (7, 9)
    assert rows["a"].resolved_at is not None and rows["b"].resolved_at is None


def test_the_last_transition_of_a_log_counts(spark):
    breaks = breaks_frame(spark, break_row("a", detected=-7200), break_row("b"))
    first = lc.escalate_stale(breaks, T0).withColumn("step", F.lit(1))
    second = lc.resolve_manually(breaks, commands_frame(spark, ("a", "x", None, 1)), at(9)).withColumn("step", F.lit(2))
    state = lc.current_state(breaks, second.unionByName(first)).collect()
    assert sorted((r.break_id, r.status) for r in state) == [("a", "RESOLVED"), ("b", "OPEN")]


def test_resolutions_need_a_break(spark):
    rows = spark.createDataFrame([("a", "MANUAL", "x", None, T0), ("z", "MANUAL", "x", None, T0)], schemas.RESOLUTION)
    assert lc.append_resolutions(breaks_frame(spark, break_row("a")), rows).count() == 1


@pytest.mark.parametrize(
    "event, closed",
    [
        (event_row(ts=0), True),
        (event_row(amount="99", ts=0), False),
        (event_row(reference=None, ts=0), True),
        (event_row(reference="other", ts=0), False),
        (event_row(ts=None), True),
        (event_row(ts=300), True),
        (event_row(ts=-300), True),
        (event_row(ts=301), False),
        (event_row(asset="EUR", ts=0), False),
        (event_row(source="CUSTODY", ts=0), False),
    ],
)
def test_auto_resolve(spark, event, closed):
    breaks = breaks_frame(spark, break_row("a"))
    moved = lc.auto_resolve(breaks, events_frame(spark, event), T0, 300)
    rows = moved.collect()
    assert len(rows) == int(closed)
    if closed:
        assert (rows[0].status, rows[0].age_seconds, rows[0].resolution_type) == ("RESOLVED", 0, "AUTO")
        want = f"auto-resolved by external event for RAILS/USD/{event[4]}"
        assert lc.resolutions_of(moved).first().note == want


def test_auto_resolve_can_be_switched_off(spark):
    moved = lc.auto_resolve(breaks_frame(spark, break_row()), events_frame(spark, event_row(ts=0)), T0, enabled=False)
    assert moved.isEmpty()


def test_auto_resolve_skips_real_and_closed_breaks(spark):
    breaks = breaks_frame(spark, break_row("a", classification="REAL"), break_row("b", status="ESCALATED"))
    assert lc.auto_resolve(breaks, events_frame(spark, event_row(ts=0)), T0).isEmpty()


@pytest.mark.parametrize("tolerance", [0, 7, 300])
def test_auto_resolve_equals_event_by_event(spark, tolerance):
    """The first event to arrive closes the break, whatever its time."""
    rng = random.Random(tolerance)
    ref = lambda: rng.choice(["x", "y", None])
    when = lambda: rng.choice([None, rng.randrange(-900, 900)])
    breaks = [
        break_row(f"b{i}", reference=ref(), internal=rng.choice(["1", None]), detected=rng.randrange(-900, 900))
        for i in range(40)
    ]
    events = [event_row(o, id=f"e{o}", reference=ref(), amount=rng.choice(["1", "0", None]), ts=when())
              for o in rng.sample(range(1000), 40)]
    want = {}
    for e in sorted(events):
        for b in breaks:
            fits = (b[7] or Decimal(0)) == (e[5] or Decimal(0)) and (e[4] is None or e[4] == b[6])
            near = e[7] is None or abs(b[10] - e[7]) <= timedelta(seconds=tolerance)
            if fits and near and b[0] not in want:
                want[b[0]] = e[1]
    got = lc.auto_resolve(breaks_frame(spark, *breaks), events_frame(spark, *events), T0, tolerance)
    assert {r.break_id: r.external_event_id for r in got.collect()} == want


def test_open_timing_breaks(spark):
    breaks = breaks_frame(spark, break_row("a"), break_row("b", reference="r2"), break_row("c", classification="REAL"))
    assert lc.open_timing_breaks(breaks, "RAILS", "USD").count() == 2
    assert [r.break_id for r in lc.open_timing_breaks(breaks, "RAILS", "USD", "r2").collect()] == ["b"]
    counted = lc.count_open_timing_breaks(
        breaks, events_frame(spark, event_row(1, "x", reference=None), event_row(2, "y", reference="r2"), event_row(3, "z", asset="EUR"))
    )
    assert {r.external_event_id: r.open_breaks for r in counted.collect()} == {"x": 2, "y": 1, "z": 0}


RULES = [
    ("RAILS", "USD", "FUZZY", 120, 30, True, "{}"),
    ("RAILS", None, "EXACT", 300, 60, False, "{}"),
    ("ONCHAIN", None, "SOMETHING", 600, 120, True, "{}"),
]


def test_strategy_of_the_first_rule(spark):
    rules = spark.createDataFrame(RULES, schemas.RULE)
    sources = spark.createDataFrame([("RAILS",), ("ONCHAIN",), ("CUSTODY",)], "source string")
    got = {r.source: r.strategy for r in rl.strategy_per_source(sources, rules).collect()}
    assert got == {"RAILS": "FUZZY", "ONCHAIN": "EXACT", "CUSTODY": "EXACT"}


def test_listing_and_lookup_of_rules(spark):
    rules = spark.createDataFrame(RULES, schemas.RULE)
    assert [(r.source, r.asset) for r in rl.list_rules(rules).collect()] == [("ONCHAIN", None), ("RAILS", "USD"), ("RAILS", None)]
    assert rl.rules_for(rules, "RAILS", "USD").count() == 2
    assert rl.rules_for(rules, "RAILS", "EUR").count() == 1
    assert rl.rules_for(rules, "RAILS").count() == 2


def test_most_specific_rule_wins(spark):
    rules = spark.createDataFrame(RULES, schemas.RULE)
    keys = spark.createDataFrame([("RAILS", "USD"), ("RAILS", "EUR"), ("CUSTODY", "USD")], "source string, asset string")
    got = {(r.source, r.asset): (r.tolerance_seconds, r.rule_level) for r in rl.with_tolerance(keys, rules).collect()}
    assert got == {("RAILS", "USD"): (120, "asset"), ("RAILS", "EUR"): (300, "source"), ("CUSTODY", "USD"): (300, "default")}


def test_upsert_replaces_what_is_given_and_inserts_the_rest(spark):
    rules = spark.createDataFrame(RULES, schemas.RULE)
    changes = spark.createDataFrame(
        [("RAILS", None, "FUZZY", None, 5, None, None), ("CUSTODY", "BTC", None, 10, None, None, None)], schemas.RULE)
    got = {(r.source, r.asset): r for r in rl.upsert_rules(rules, changes).collect()}
    assert len(got) == 4
    changed = got["RAILS", None]
    assert (changed.match_strategy, changed.tolerance_seconds, changed.escalation_age_minutes, changed.auto_resolve_timing) == ("FUZZY", 300, 5, False)
    new = got["CUSTODY", "BTC"]
    assert (new.match_strategy, new.tolerance_seconds, new.escalation_age_minutes, new.auto_resolve_timing) == ("EXACT", 10, 60, True)
    again = rl.upsert_rules(rl.upsert_rules(rules, changes), changes)
    assert again.count() == 4


def test_alert_message_has_thirteen_fields(spark):
    message = ev.as_messages(ev.alerts(breaks_frame(spark, break_row("a")), "detected", "system", F.lit(T0))).first()
    body = json.loads(message.value)
    assert (message.topic, message.key, len(body)) == ("break-alert", "a", 13)
    assert (body["internal_amount"], body["external_amount"], body["timestamp"]) == ("100.00000000", None, "2024-01-01T00:00:00Z")


def test_envelope_hash_follows_the_payload(spark):
    breaks = breaks_frame(spark, break_row("a"), break_row("b"))
    rows = ev.envelope(ev.detected_audits(breaks, F.lit(T0))).collect()
    payload = json.loads(rows[0].payload)
    assert list(payload) == sorted(payload)
    assert payload["before"] == {} and payload["after"] == {"classification": "TIMING", "run_id": "r1"}
    assert rows[0].action == "recon.detected" and rows[0].payload_hash.startswith("sha256:")
    assert rows[0].payload_hash != rows[1].payload_hash


def test_replay_rebuilds_the_lifecycle(spark):
    breaks = breaks_frame(spark, break_row("a", detected=-7200), break_row("b"))
    detected = ev.detected_audits(breaks, F.lit(at(-7200)))
    escalated = lc.audits_of(lc.escalate_stale(breaks, T0))
    resolved = lc.audits_of(lc.resolve_manually(breaks, commands_frame(spark, ("a", "x", None, 1)), at(5)))
    rows = ev.replay(detected.unionByName(escalated).unionByName(resolved)).collect()
    steps = sorted((r.break_id, r.step, r.action, r.final_status) for r in rows)
    assert steps == [("a", 1, "detected", "RESOLVED"), ("a", 2, "escalated", "RESOLVED"),
                     ("a", 3, "manually-resolved", "RESOLVED"), ("b", 1, "detected", "OPEN")]
