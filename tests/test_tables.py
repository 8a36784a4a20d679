"""Keyed tables, the id index, the message sink, breaks at past times."""

import json
import random
from pathlib import Path

import pytest
from helpers import at, break_row, breaks_frame, event_row
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.streaming import break_table, jobs, message_sink
from tallymark.streaming.id_index import IdIndex
from tallymark.streaming.store import KeyedTable


def ids(spark, *names):
    return spark.createDataFrame([("RAILS", n) for n in names], "source string, external_event_id string")


def test_index_of_ids(spark, tmp_path):
    """Whatever has merged, all ids are known; a lookup opens few files, however long the history."""
    index = IdIndex(spark, f"{tmp_path}/ids", buckets=8, fan=3)
    for n in range(13):
        index.add(n, ids(spark, *[f"e{n}-{k}" for k in range(4)]))
        assert len(index.runs(n + 1)) <= 2 * 3
    every = [f"e{n}-{k}" for n in range(13) for k in range(4)]
    assert sorted(r.external_event_id for r in index.known(ids(spark, *every, "x"), 13).collect()) == sorted(every)
    assert sorted(r.external_event_id for r in index.known(ids(spark, *every), 2).collect()) == sorted(every[:8])
    assert index.known(ids(spark, "e0-1"), 0).isEmpty()
    # A commit that is repeated, and a merge that was never finished.
    index.add(12, ids(spark, "new"))
    assert [r.external_event_id for r in index.known(ids(spark, "new", "e12-0"), 13).collect()] == ["new"]
    (Path(f"{tmp_path}/ids/level=2/run=0") / "_SUCCESS").rename(tmp_path / "elsewhere")
    assert index.known(ids(spark, *every[:36]), 13).count() == 36


def test_files_opened_do_not_grow(spark, tmp_path):
    index, counts = IdIndex(spark, f"{tmp_path}/ids", buckets=4, fan=2), []
    for n in range(16):
        index.add(n, ids(spark, *[f"e{n}-{k}" for k in range(8)]))
        plan = index.opened(index._hashed(ids(spark, "e0-1")), n + 1)
        counts.append((len(index.runs(n + 1)), plan.count()))
    assert counts[7][0] == 1 and counts[15][0] == 1 and max(c for c, _ in counts) == 4
    assert all(n <= 1 for _, n in counts)


def test_ingestion_asks_the_index(spark, tmp_path):
    job = jobs.Ingestion(spark, f"{tmp_path}/out")
    for n in range(3):
        rows = [("rail.events.v1", 0, 10 * n + k, "k", json.dumps({"external_event_id": f"e{k}", "amount": str(n)})) for k in range(n + 1)]
        job.handle(spark.createDataFrame(rows, schemas.MESSAGE), n)
    stored = {r.external_event_id: json.loads(r.payload)["amount"] for r in job.events.rows().collect()}
    assert stored == {"e0": "0", "e1": "1", "e2": "2"}


def test_events_are_listed_as_they_were_ingested(spark, tmp_path):
    """A later micro-batch has the smaller offset of another partition."""
    times = iter([at(10), at(20)])
    job = jobs.Ingestion(spark, f"{tmp_path}/out", now=lambda: next(times))
    for n, (partition, offset) in enumerate(((1, 100), (0, 5))):
        body = json.dumps({"external_event_id": f"e{n}"})
        job.handle(spark.createDataFrame([("rail.events.v1", partition, offset, "k", body)], schemas.MESSAGE), n)
    rows = job.listed("RAILS").collect()
    assert [r.external_event_id for r in rows] == ["e0", "e1"] and rows[0].ord > rows[1].ord
    assert rows[0].ingested_at < rows[1].ingested_at and job.listed(limit=1).count() == 1


@pytest.mark.parametrize("once", [False, True])
def test_keyed_table(spark, tmp_path, once):
    table = KeyedTable(spark, f"{tmp_path}/t", schemas.COMMAND, compact_every=3, once=once)
    rng, want = random.Random(2), {}
    assert table.state(-1).isEmpty()
    for n in range(7):
        new = {f"k{n}-{k}": f"note{n}" for k in range(4)}
        if not once:
            new |= dict.fromkeys(rng.sample(sorted(want), min(2, len(want))), f"changed{n}")
        gone = rng.sample(sorted(set(want) - set(new)), min(2, len(want) // 2))
        rows = spark.createDataFrame([(k, "b", "a", v) for k, v in new.items()], "key string, break_id string, actor string, note string")
        for _ in range(2):
            table.commit(n, rows, spark.createDataFrame([(g,) for g in gone], "key string"))
        want = {k: v for k, v in (want | new).items() if k not in gone}
        assert {r.key: r.note for r in table.state(n).collect()} == want


def test_messages_are_left_once(spark, tmp_path):
    path = f"{tmp_path}/sink"
    rows = spark.createDataFrame([("audit.v1", f"k{n}", f'{{"n": {n}, "é": null}}') for n in range(20)], message_sink.MESSAGE).repartition(3)
    fails = F.udf(lambda k: 1 // (0 if k == "k7" else 1), "int")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        message_sink.send(rows.where(fails("key") > 0), path, "batch-0")
    assert message_sink.sent(spark, path).isEmpty()
    for _ in range(2):
        message_sink.send(rows, path, "batch-0")
    message_sink.send(rows.limit(1), path, "batch-1")
    got = message_sink.sent(spark, path)
    assert got.where("commit = 'batch-0'").count() == 20 and got.count() == 21
    assert {r.key: json.loads(r.value)["n"] for r in got.collect()}["k3"] == 3


def test_messages_of_a_stream_are_left_once(spark, tmp_path):
    source, path = tmp_path / "in", f"{tmp_path}/sink"
    spark.createDataFrame([("recon-dlq", f"k{n}", "{}") for n in range(3)], message_sink.MESSAGE).write.parquet(str(source))
    # The second time with a lost checkpoint: the batch has its number again and is found to be there.
    for checkpoint in ("cp", "cp2"):
        stream = spark.readStream.schema(message_sink.MESSAGE).parquet(str(source))
        message_sink.send_stream(stream, path, f"{tmp_path}/{checkpoint}").awaitTermination()
    assert sorted(r.key for r in message_sink.sent(spark, path).collect()) == ["k0", "k1", "k2"]


def test_dead_letters_are_sent(spark, tmp_path):
    job = jobs.Ingestion(spark, f"{tmp_path}/out")
    job.handle(spark.createDataFrame([("rail.events.v1", 0, 1, "k", "{")], schemas.MESSAGE), 0)
    for _ in range(2):
        job.send(f"{tmp_path}/sink", 0)
    (letter,) = message_sink.sent(spark, f"{tmp_path}/sink").collect()
    assert letter.topic == "recon-dlq" and json.loads(letter.value)["error"] == "payload is not a JSON object"


RULES = [("RAILS", None, "EXACT", 300, 60, True, "{}"), ("RAILS", "EUR", "EXACT", 10, 10, True, "{}"), ("CUSTODY", None, "EXACT", 300, 60, False, "{}")]


def changed(spark, *rows):
    """Rows (ord, kind, at, part) of a micro-batch."""
    out = []
    for ord, kind, time, part in rows:
        parts = {"break": (part, None, None), "event": (None, part, None), "command": (None, None, part)}.get(kind, (None,) * 3)
        out.append((ord, kind, at(time), *parts))
    return spark.createDataFrame(out, break_table.CHANGE)


def shared(spark, tmp_path, compact_every):
    job = break_table.SharedBreaks(spark, f"{tmp_path}/out", spark.createDataFrame(RULES, schemas.RULE), compact_every, buckets=4)
    batches = [
        [(1, "break", 0, break_row("a")), (2, "break", 0, break_row("b", asset="EUR", reference="r2")), (3, "break", 0, break_row("c", source="CUSTODY", reference="r3")),
         (4, "break", 0, break_row("d", reference="r4")), (9, "tick", 60, None)],
        # b: too far for its rule's tolerance; c: its source's rule forbids it; d: a command was earlier.
        [(11, "event", 70, event_row(1, reference="ref1", ts=100)), (12, "event", 70, event_row(2, asset="EUR", reference="r2", ts=100)),
         (13, "event", 70, event_row(3, source="CUSTODY", reference="r3", ts=0)), (14, "command", 71, ("d", "escalate", "op", "why")),
         (15, "event", 72, event_row(4, reference="r4", ts=0)), (19, "tick", 700, None)],
        # a is closed, so the same is a new break; c is open still, so it is not.
        [(21, "break", 800, break_row("a2")), (22, "break", 800, break_row("c2", source="CUSTODY", reference="r3")), (23, "break", 800, break_row("a")),
         (24, "command", 900, ("d", "resolve", "op", None)), (25, "command", 950, ("d", "resolve", "op", None)), (26, "command", 950, ("?", "resolve", "op", None)),
         (29, "tick", 4000, None)],
    ]
    for n, rows in enumerate(batches):
        for _ in range(2):
            job.handle(changed(spark, *rows), n)
    return job


@pytest.mark.parametrize("compact_every", [None, 2])
def test_shared_breaks(spark, tmp_path, compact_every):
    job = shared(spark, tmp_path, compact_every)
    state = {r.break_id: (r.status, r.age_seconds) for r in job.table.state().collect()}
    assert state == {"a": ("RESOLVED", 0), "b": ("ESCALATED", 700), "c": ("ESCALATED", 4000), "d": ("RESOLVED", 71), "a2": ("ESCALATED", 4000)}
    log = sorted((r.commit, r.seq, r.break_id, r.action, r.before_status) for r in job.table.versions().collect())
    assert [x[2:] for x in log if x[2] == "d"] == [
        ("d", "detected", None), ("d", "escalated", "OPEN"), ("d", "manually-resolved", "ESCALATED"), ("d", "manually-resolved", "RESOLVED")]
    closed = {r.break_id: r.resolved_at for r in job.table.state().collect()}
    assert closed["a"] == at(70).replace(tzinfo=None) and closed["d"] == at(900).replace(tzinfo=None)
    assert {r.break_id for r in job.table.state(1, open_only=True).collect()} == {"c"}
    assert {r.break_id for r in job.table.state(ids=breaks_frame(spark, break_row("d"), break_row("b"))).collect()} == {"b", "d"}
    # Every past time, against all versions up to then.
    for seconds in (0, 60, 70, 71, 500, 700, 800, 900, 3999, 4000):
        want = {}
        for r in sorted(job.table.versions().collect(), key=lambda r: (r.commit, r.seq)):
            if r.at <= at(seconds).replace(tzinfo=None):
                want[r.break_id] = (r.status, r.age_seconds)
        assert {r.break_id: (r.status, r.age_seconds) for r in job.table.state_at(at(seconds)).collect()} == want
    assert job.table.state_at(at(-1)).isEmpty()
    if compact_every:
        # A state opens its snapshot and the commits since, not the whole log.
        files = {f.rsplit("/out/breaks/", 1)[1] for f in job.table.state(open_only=True).inputFiles()}
        assert not any(f.startswith(("log/epoch=0/commit=0", "log/epoch=0/commit=1")) for f in files)
        assert any(f.startswith("snapshots/commit=1") for f in files) and any("commit=2" in f for f in files)
