import hashlib
import json
import os

import pytest
from helpers import T0, at, break_row, breaks_frame, event_row, ledger_row
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.streaming import jobs
from tallymark.streaming.store import run_available


def land(folder, n, rows):
    folder.mkdir(exist_ok=True)
    file = folder / f"{n:03}.json"
    file.write_text("".join(json.dumps(r) + "\n" for r in rows))
    # A file source takes files by age.
    os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))


def message(offset, payload, topic="rail.events.v1", partition=0):
    value = payload if isinstance(payload, str) else json.dumps(payload)
    return {"topic": topic, "partition": partition, "offset": offset, "key": "k", "value": value}


def event(id, **more):
    return {"external_event_id": id, "asset": "USD", "amount": "100", "reference": "ref1", **more}


def test_ingestion_over_several_batches(spark, tmp_path):
    """Redelivery within and across micro-batches, poison, unknown topics."""
    landing = tmp_path / "in"
    land(landing, 0, [message(0, event("a", amount="1")), message(1, "poison"), message(2, event("a", amount="2"))])
    land(landing, 1, [message(3, event("a", amount="3")), message(4, event("b")), message(5, event("x"), "nope")])
    land(landing, 2, [message(6, {"asset": "USD"}, "ledger.events.v1"), message(7, event("c", amount="?"))])
    job = jobs.Ingestion(spark, f"{tmp_path}/out")
    stream = jobs.read_landed_messages(spark, str(landing), files_per_trigger=1)
    run_available(stream, job.handle, f"{tmp_path}/cp")
    stored = {(r.source, r.external_event_id): json.loads(r.payload).get("amount") for r in job.events.rows().collect()}
    assert stored == {("RAILS", "a"): "1", ("RAILS", "b"): "100", ("LEDGER", "ledger.events.v1:0:6"): None}
    assert sorted(r.offset for r in job.dead_letters.rows().collect()) == [1, 7]
    # Everything delivered again with a lost checkpoint: nothing new.
    again = jobs.read_landed_messages(spark, str(landing))
    run_available(again, lambda f, i: job.handle(f, i + 100), f"{tmp_path}/cp2")
    assert job.events.rows().count() == 3


def test_repeated_micro_batch_leaves_the_same_tables(spark, tmp_path):
    job = jobs.Ingestion(spark, f"{tmp_path}/out")
    rows = [message(0, event("a")), message(1, "poison")]
    batch = spark.createDataFrame([tuple(r[c] for c in schemas.columns(schemas.MESSAGE)) for r in rows], schemas.MESSAGE)
    for _ in range(2):
        job.handle(batch, 0)
    assert job.events.rows().count() == 1 and job.dead_letters.rows().count() == 1


def test_new_events_close_timing_breaks_once(spark, tmp_path):
    landing = tmp_path / "in"
    stamp = "2024-01-01T00:00:10Z"
    land(landing, 0, [message(0, event("a", timestamp=stamp, reference="ref1"))])
    land(landing, 1, [message(1, event("b", timestamp=stamp, reference=None))])
    breaks = breaks_frame(spark, break_row("x"), break_row("y", reference="other"), break_row("z", internal="7"))
    job = jobs.Ingestion(spark, f"{tmp_path}/out", breaks=breaks, now=lambda: T0)
    run_available(jobs.read_landed_messages(spark, str(landing), 1), job.handle, f"{tmp_path}/cp")
    closed = job.transitions.read().select("break_id", "batch_id", "resolution_type").collect()
    assert sorted(tuple(r) for r in closed) == [("x", 0, "AUTO"), ("y", 1, "AUTO")]
    state = {r.break_id: r.status for r in job.state().collect()}
    assert state == {"x": "RESOLVED", "y": "RESOLVED", "z": "OPEN"}


def test_switched_off_auto_resolution(spark, tmp_path):
    job = jobs.Ingestion(spark, f"{tmp_path}/out", breaks=breaks_frame(spark, break_row()), auto_resolve=False)
    batch = spark.createDataFrame([("rail.events.v1", 0, 0, "k", json.dumps(event("a")))], schemas.MESSAGE)
    job.handle(batch, 0)
    assert job.transitions.rows().isEmpty()


def entries(spark, ledger, events):
    return jobs.IncrementalMatch.input(
        spark.createDataFrame(ledger, schemas.LEDGER), spark.createDataFrame(events, schemas.EXTERNAL)
    )


def test_incremental_match_waits_then_breaks(spark, tmp_path):
    job = jobs.IncrementalMatch(spark, f"{tmp_path}/out", "run", "RAILS", tolerance_seconds=300)
    job.handle(entries(spark, [ledger_row(1, "a", ts=0), ledger_row(2, "b", ts=10)], [event_row(1, reference="c", ts=5)]), 0)
    assert job.pairs.rows().isEmpty() and job.breaks.rows().isEmpty()
    job.handle(entries(spark, [], [event_row(2, reference="b", ts=200)]), 1)
    job.handle(entries(spark, [], [event_row(2, reference="b", ts=200)]), 1)
    assert [tuple(r) for r in job.pairs.rows().collect()] == [(2, 2)]
    job.handle(entries(spark, [ledger_row(3, "d", ts=304)], []), 2)
    assert [(r.type, r.reference) for r in job.breaks.rows().collect()] == [("TIMING_GAP", "a")]
    job.close(2, at(1000))
    assert sorted((r.type, r.reference) for r in job.breaks.rows().collect()) == [
        ("MISSING_ENTRY", "c"), ("TIMING_GAP", "a"), ("TIMING_GAP", "d")]


def test_incremental_match_as_a_stream(spark, tmp_path):
    source = tmp_path / "rows"
    rows = entries(spark, [ledger_row(i, f"r{i}", ts=i) for i in range(20)], [event_row(i, reference=f"r{i}", ts=i) for i in range(5, 25)])
    rows.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    job = jobs.IncrementalMatch(spark, f"{tmp_path}/out", "run", "RAILS", 10_000)
    run_available(stream, job.handle, f"{tmp_path}/cp")
    assert sorted(tuple(r) for r in job.pairs.rows().collect()) == [(i, i) for i in range(5, 20)]
    last = job.clock.read().agg(F.max("batch_id")).first()[0]
    assert last == 2 and job.waiting.state(last).count() == 10


def test_escalation_on_every_trigger(spark, tmp_path):
    clock = iter([at(3600), at(3700)])
    job = jobs.Escalation(spark, f"{tmp_path}/out", 60, now=lambda: next(clock))
    job.handle(breaks_frame(spark, break_row("a"), break_row("b", detected=50)), 0)
    job.handle(breaks_frame(spark, break_row("c", detected=3000)), 1)
    assert sorted((r.break_id, r.batch_id) for r in job.transitions.read().collect()) == [("a", 0), ("b", 1)]


def test_escalation_in_a_quiet_stream(spark, tmp_path):
    clock = [at(0)]
    job = jobs.Escalation(spark, f"{tmp_path}/out", 60, now=lambda: clock[0])
    job.handle(breaks_frame(spark, break_row("a"), break_row("b", detected=50)), 0)
    for seconds, escalated in ((10, []), (3600, ["a"]), (3601, ["a"]), (9000, ["a", "b"])):
        clock[0] = at(seconds)
        job.tick()
        assert sorted(r.break_id for r in job.all_transitions().collect()) == escalated
    job.handle(breaks_frame(spark, break_row("c", detected=8000)), 1)
    assert job.all_transitions().count() == 2 and sorted(r.key for r in job.alerts().collect()) == ["a", "b"]


def test_ids_are_stored_once_for_ever(spark, tmp_path):
    job = jobs.Ingestion(spark, f"{tmp_path}/out")
    stamps = ["2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "2023-01-01T00:00:00Z", "2024-03-01T00:00:00Z"]
    for n, (stamp, ids) in enumerate(zip(stamps, (["a"], ["b"], ["late"], ["a", "late", "b", "c"]), strict=True)):
        rows = [("rail.events.v1", 0, 10 * n + k, "k", json.dumps(event(i, timestamp=stamp))) for k, i in enumerate(ids)]
        job.handle(spark.createDataFrame(rows, schemas.MESSAGE), n)
    assert sorted(r.external_event_id for r in job.events.rows().collect()) == ["a", "b", "c", "late"]


def test_messages_of_a_stream(spark, tmp_path):
    stamp = "2024-01-01T00:00:00Z"
    job = jobs.Ingestion(spark, f"{tmp_path}/out", breaks=breaks_frame(spark, break_row("x")), now=lambda: T0)
    rows = [("rail.events.v1", 0, 0, "k", json.dumps(event("a", timestamp=stamp, reference="ref1"))), ("rail.events.v1", 0, 1, "k", "{")]
    job.handle(spark.createDataFrame(rows, schemas.MESSAGE), 0)
    audit = job.audits().first()
    body = json.loads(audit.value)
    assert (audit.topic, audit.key, body["payload"]["action"]) == ("audit.v1", "x", "auto-resolved")
    text = json.dumps(body["payload"], separators=(",", ":"), ensure_ascii=False)
    assert body["payload_hash"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    letter = job.dead_letter_messages().first()
    assert letter.topic == "recon-dlq" and json.loads(letter.value)["error"] == "payload is not a JSON object"


def test_a_row_dated_in_the_future_ends_no_wait(spark, tmp_path):
    job = jobs.IncrementalMatch(spark, f"{tmp_path}/out", "run", "RAILS", 300, now=lambda: at(100))
    job.handle(entries(spark, [ledger_row(1, "a", ts=0), ledger_row(2, "b", ts=10**8)], []), 0)
    assert job.breaks.rows().isEmpty() and job.waiting.state(0).count() == 2


def test_bounded_deduplication(spark, tmp_path):
    source = tmp_path / "ev"
    for n, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        land(source, n, [{"source": "RAILS", "external_event_id": i, "at": f"2024-01-01T00:0{n}:00Z"} for i in ids])
    stream = spark.readStream.schema("source string, external_event_id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    kept = jobs.drop_redelivered(stream, "at", "1 hour")
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(
        availableNow=True).start().awaitTermination()
    assert sorted(r.external_event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("raw", [b"x", None])
def test_kafka_rows_become_messages(spark, raw):
    frame = spark.createDataFrame([("t", 0, 1, raw, bytearray(b"{}"))], "topic string, partition int, offset bigint, key binary, value binary")
    row = jobs.kafka_messages(frame).first()
    assert row.value == "{}" and row.key == (None if raw is None else "x")
