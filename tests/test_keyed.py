"""Keyed streaming state: pairing with deadlines, escalation by timers."""

import os
import random
from pathlib import Path

import pytest
from helpers import at, event_row, ledger_row

from tallymark import schemas
from tallymark.operators.matching import side_by_side
from tallymark.streaming import keyed
from tallymark.streaming.store import written


def sides(spark, ledger, events):
    return side_by_side(spark.createDataFrame(ledger, schemas.LEDGER), spark.createDataFrame(events, schemas.EXTERNAL))


def in_files(spark, folder, *batches):
    """A stream with one micro-batch for each of the frames."""
    for batch in batches:
        known = set(Path(folder).glob("part-*.parquet"))
        batch.coalesce(1).write.mode("append").parquet(str(folder))
        # A file source takes files by age.
        (new,) = set(Path(folder).glob("part-*.parquet")) - known
        os.utime(new, (1_700_000_000 + len(known), 1_700_000_000 + len(known)))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], -1 if r[2] is None else r[2]))


def test_rows_wait_pair_and_end(spark, tmp_path):
    stream = keyed.match_stream(in_files(
        spark, tmp_path / "in",
        sides(spark, [ledger_row(1, "a", ts=0), ledger_row(2, "b", ts=10), ledger_row(3, "never", ts=None)], [event_row(1, reference="c", ts=5)]),
        sides(spark, [], [event_row(2, reference="b", ts=200), event_row(3, reference="b", ts=200)]),
        sides(spark, [ledger_row(4, "d", ts=304)], []),
        sides(spark, [], [event_row(5, reference="a", ts=400)]),
    ), 300)
    out = written(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    found = by_key((r.kind, r.l and r.l.ord, r.e and r.e.ord) for r in out.collect())
    # a is still there when its event comes in the micro-batch after the clock has passed it; c is ended by that clock.
    assert found == by_key([("pair", 1, 5), ("pair", 2, 2), ("DUPLICATE", None, 3), ("ended", None, 1)])
    kinds = sorted((r.type, r.reference) for r in keyed.breaks_of(out, "run", "RAILS", 300).collect())
    assert kinds == [("DUPLICATE", "b"), ("MISSING_ENTRY", "c")]
    left = keyed.still_waiting(spark, f"{tmp_path}/cp")
    assert sorted((r.side, r.ord) for r in left.collect()) == [(0, 3), (0, 4), (1, 3)]


def serial(batches, patience, delay):
    """The same by lists: all rows of a batch, then what has ended by the clock before it."""
    waiting, out, clock, copies = [], [], 0, {}
    for batch in [*batches, []]:
        for side, ord, ref, ts in sorted(batch, key=lambda r: (r[1], r[0])):
            if side == 1:
                n, until = copies.get(ref, (0, 0))
                copies[ref] = (n + 1, max(until, float("inf") if ts is None else ts + patience))
                if n + 1 == 2:
                    out.append(("DUPLICATE", None, ord))
            other = next((w for w in waiting if w[0] != side and w[2] == ref), None)
            if other is None:
                waiting.append((side, ord, ref, ts))
                continue
            waiting.remove(other)
            out.append(("pair", *((ord, other[1]) if side == 0 else (other[1], ord))))
        for w in [w for w in waiting if w[3] is not None and w[3] + patience < clock]:
            waiting.remove(w)
            out.append(("ended", w[1] if w[0] == 0 else None, w[1] if w[0] == 1 else None))
        for ref in [r for r, (_, until) in copies.items() if until < clock]:
            del copies[ref]
        clock = max([clock, *(r[3] - delay for r in batch if r[3] is not None)])
    return by_key(out), sorted((w[0], w[1]) for w in waiting)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_serial_restatement(spark, tmp_path, seed):
    """Late rows, rows without a time, one hot key, several batches."""
    rng = random.Random(seed)
    batches, n = [], 0
    for b in range(5):
        batch = []
        for _ in range(60):
            n += 1
            ts = None if rng.random() < 0.05 else max(0, 100 * b + rng.randint(-150, 100)) + 0.5
            batch.append((rng.randint(0, 1), n, rng.choice(["hot"] * 3 + [f"r{rng.randint(0, 30)}"] * 4), ts))
        batches.append(batch)
    frames = [sides(spark, [ledger_row(o, r, ts=t) for s, o, r, t in b if s == 0], [event_row(o, reference=r, ts=t) for s, o, r, t in b if s == 1])
              for b in batches]
    stream = keyed.match_stream(in_files(spark, tmp_path / "in", *frames), 120, "40 seconds")
    out = written(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    want, waiting = serial(batches, 120, 40)
    # Times of the test start at 2024, the clock of the restatement at 0: the first batch ends nothing in both.
    assert by_key((r.kind, r.l and r.l.ord, r.e and r.e.ord) for r in out) == want
    assert sorted((r.side, r.ord) for r in keyed.still_waiting(spark, f"{tmp_path}/cp").collect()) == waiting


def test_many_keys_pair_in_the_jvm(spark, tmp_path):
    """Many keys and one with many rows of the same deadline, told apart by party; no state goes through Python."""
    ledger = [ledger_row(k, f"r{k}", ts=0) for k in range(2000)] + [ledger_row(2000 + k, "hot", counterparty=f"c{k % 3}", ts=0) for k in range(300)]
    events = [event_row(k, reference=f"r{k}", ts=0) for k in range(0, 2000, 2)] + [
        event_row(2000 + k, reference="hot", counterparty="c1", ts=0) for k in range(40)]
    nothing = [event_row(5000, reference=None, amount=None, counterparty=None, ts=0), event_row(5001, reference=None, amount=None, counterparty=None, ts=0)]
    stream = keyed.match_stream(in_files(
        spark, tmp_path / "in", sides(spark, ledger, nothing), sides(spark, [], events), sides(spark, [ledger_row(9000, "later", ts=9000)], []),
    ), 300)
    assert "InPySpark" not in stream._jdf.queryExecution().analyzed().toString()
    out = written(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    found = {kind: sorted((r.l and r.l.ord, r.e and r.e.ord) for r in out if r.kind == kind) for kind in ("pair", "DUPLICATE")}
    served = [r[0] for r in ledger if r[4] == "c1"][:40]
    assert found["pair"] == sorted([(k, k) for k in range(0, 2000, 2)] + list(zip(served, range(2000, 2040))))
    assert found["DUPLICATE"] == [(None, 2001), (None, 5001)]
    ended = [(0, r.l.ord) if r.l else (1, r.e.ord) for r in out if r.kind == "ended"]
    assert sorted(ended) == sorted([(0, r[0]) for r in ledger if r[0] not in served and (r[0] >= 2000 or r[0] % 2)] + [(1, 5000), (1, 5001)])
    left = keyed.still_waiting(spark, f"{tmp_path}/cp").collect()
    assert [(r.side, r.ord, r.amount, r.ts.timestamp()) for r in left] == [(0, 9000, 100, at(9000).timestamp())]


def changes(spark, *rows):
    return spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], "break_id string, source string, asset string, kind string, at timestamp")


def test_escalation_by_timers(spark, tmp_path):
    rules = spark.createDataFrame([("RAILS", "EUR", "EXACT", 300, 10, True, "{}"), ("CUSTODY", None, "EXACT", 300, 30, True, "{}")], schemas.RULE)
    stream = in_files(
        spark, tmp_path / "in",
        changes(spark, ("a", "RAILS", "USD", "opened", 0), ("b", "RAILS", "EUR", "opened", 0), ("c", "RAILS", "USD", "opened", 0)),
        changes(spark, ("c", "RAILS", "USD", "closed", 3599), ("d", "CUSTODY", "USD", "opened", 100)),
        # Nothing but the clock: d is due; e comes in late and long due; f was closed in time, which is told late.
        changes(spark, ("", None, None, "tick", 3000)),
        changes(spark, ("e", "RAILS", "EUR", "opened", 200), ("f", "RAILS", "EUR", "opened", 200), ("f", "RAILS", "EUR", "closed", 700)),
        changes(spark, ("b", "RAILS", "EUR", "closed", 5000), ("", None, None, "tick", 9000)),
    )
    out = written(keyed.escalations(stream, rules), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r.break_id, r.age_seconds) for r in out) == [("a", 3600), ("b", 600), ("d", 1800), ("e", 600)]
    assert {r.break_id: r.at_ms for r in out}["d"] == int(at(1900).timestamp() * 1000)


def test_escalation_survives_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    stream = in_files(spark, source, changes(spark, ("a", "RAILS", "USD", "opened", 0)))
    assert written(keyed.escalations(stream), f"{tmp_path}/out", f"{tmp_path}/cp").isEmpty()
    stream = in_files(spark, source, changes(spark, ("", None, None, "tick", 3600)))
    for _ in range(2):
        out = written(keyed.escalations(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert [r.break_id for r in out.collect()] == ["a"]


def test_many_deadlines_stay_in_the_jvm(spark, tmp_path):
    """Opened, closed and told twice, over two micro-batches and a tick; no state goes through Python."""
    rng = random.Random(5)
    batches, told = [[], []], {}
    for k in range(4000):
        for _ in range(rng.choice([1, 1, 2])):
            kind, t = rng.choice(["opened", "opened", "closed"]), rng.randint(0, 7000)
            batches[t > 4000].append((f"b{k}", "RAILS", "USD", kind, t))
            told.setdefault(f"b{k}", {}).setdefault(kind, []).append(t)
    stream = keyed.escalations(in_files(spark, tmp_path / "in", *[changes(spark, *b) for b in batches], changes(spark, ("", None, None, "tick", 9000))))
    assert "InPySpark" not in stream._jdf.queryExecution().analyzed().toString()
    out = written(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    due = {b: min(t["opened"]) + 3600 for b, t in told.items() if "opened" in t}
    want = {b: d for b, d in due.items() if d <= 9000 and min(told[b].get("closed", [d])) >= d}
    assert len(out) == len(want) > 1000 and {r.break_id: r.at_ms for r in out} == {b: int(at(d).timestamp() * 1000) for b, d in want.items()}


def test_written_bytes_follow_the_batch(spark, tmp_path):
    """A quiet micro-batch uploads little, however many rows wait."""
    def size():
        return sum(f.stat().st_size for f in (tmp_path / "cp" / "state").rglob("*") if f.is_file() and f.suffix == ".changelog")

    many = sides(spark, [ledger_row(k, f"r{k}", ts=0) for k in range(3000)], [])
    source = tmp_path / "in"
    stream = in_files(spark, source, many)
    written(keyed.match_stream(stream, 300), f"{tmp_path}/out", f"{tmp_path}/cp")
    first = size()
    stream = in_files(spark, source, sides(spark, [], [event_row(5, reference="r5", ts=10)]))
    out = written(keyed.match_stream(stream, 300), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r.kind for r in out.collect()] == ["pair"] and size() - first < 0.05 * first
