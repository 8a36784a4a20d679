"""Literal inputs and plain restatements of the pairing rules."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from tallymark import schemas

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def ledger_row(ord=0, reference="ref1", asset="USD", amount="100", counterparty="bank1", ts=None):
    return (ord, reference, asset, None if amount is None else Decimal(amount), counterparty, at(ts))


def event_row(ord=0, id="ext1", source="RAILS", asset="USD", reference="ref1", amount="100",
              counterparty="bank1", ts=None):
    money = None if amount is None else Decimal(amount)
    return (ord, id, source, asset, reference, money, counterparty, at(ts))


def frames(spark, ledger, events):
    return (
        spark.createDataFrame(ledger, schemas.LEDGER),
        spark.createDataFrame(events, schemas.EXTERNAL),
    )


def greedy_exact(ledger, events):
    """Ledger rows in order, first unused event that agrees."""
    used, pairs = set(), []
    for l in sorted(ledger):
        for e in sorted(events):
            if e[0] in used:
                continue
            same = (
                l[1] == (e[4] or "")
                and l[2] == e[3]
                and l[3] == (e[5] or 0)
                and (l[4] or None) == (e[6] or None)
            )
            if same:
                used.add(e[0])
                pairs.append((l[0], e[0]))
                break
    return sorted(pairs)


def greedy_fuzzy(ledger, events, tolerance):
    """Ledger rows in order, nearest unused event; one without a time is taken at once."""
    used, pairs = set(), []
    for l in sorted(ledger, key=lambda r: r[0]):
        best, gap = None, None
        for e in sorted(events, key=lambda r: r[0]):
            if e[0] in used or l[2] != e[3] or l[3] != (e[5] or 0):
                continue
            if l[5] is None or e[7] is None:
                best = e
                break
            delta = abs((l[5] - e[7]) / timedelta(microseconds=1))
            if delta <= tolerance * 1_000_000 and (gap is None or delta < gap):
                best, gap = e, delta
        if best is not None:
            used.add(best[0])
            pairs.append((l[0], best[0], int(gap or 0)))
    return sorted(pairs)


def break_row(id="b1", run_id="r1", type="TIMING_GAP", classification="TIMING", source="RAILS", asset="USD",
              reference="ref1", internal="100", external=None, status="OPEN", detected=0, resolved=None, age=0):
    money = lambda v: None if v is None else Decimal(v)
    return (id, run_id, type, classification, source, asset, reference, money(internal), money(external),
            status, at(detected), at(resolved), age)


def breaks_frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.BREAK)


def events_frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.EXTERNAL)


def commands_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "break_id string, actor string, note string, ord bigint")
