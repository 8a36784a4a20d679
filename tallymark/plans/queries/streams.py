"""Streaming jobs run to the end of what is there; results equal the batch ones."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.plans.fixtures import view, with_inputs
from tallymark.plans.queries.ingest import FIRST, MESSAGES, message_rows
from tallymark.plans.queries.lifecycle import CLOSED
from tallymark.plans.registry import AGE_SQL, NOW, RUN_ID, RUN_SOURCE, TOLERANCE, query, us
from tallymark.session import materialise, run_folder
from tallymark.streaming import break_table, jobs, keyed
from tallymark.streaming.store import run_available, written


MICRO_BATCHES = 4


def in_micro_batches(rows: DataFrame, order: str) -> DataFrame:
    """The rows with `_batch`, a number from 0 by `order`: ranges of even size, each cut by many tasks."""
    spread = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartitionByRange(MICRO_BATCHES * spread, order)
    return rows.withColumn("_batch", F.floor(F.spark_partition_id() / spread))


def in_turn(rows: DataFrame, run) -> None:
    """Lets `_batch` 0, 1, ... arrive one after the other; `run` takes the stream and works off what is there.

    A micro-batch has as many files as its size asks for. Each run starts anew
    from the checkpoint, as after a restart.
    """
    spark, place = rows.sparkSession, run_folder(rows.sparkSession, "arriving")
    kept = materialise(rows)
    stream = None
    for part in range(MICRO_BATCHES):
        own = kept.where(F.col("_batch") == part).drop("_batch")
        own.write.mode("append").parquet(place)
        stream = stream or spark.readStream.schema(own.schema).parquet(place)
        run(stream)


def _messages(spark, d):
    return in_micro_batches(message_rows(spark, d), "offset")


@query(
    "stream_ingest",
    with_inputs(["fx_messages"], MESSAGES + FIRST.format(rows="good") + """
SELECT 'event' AS kind, source, external_event_id AS id, body AS content FROM firsts
UNION ALL SELECT 'dead letter', topic, concat(part, ':', pos), error FROM checked WHERE error IS NOT NULL"""),
)
def stream_ingest(spark, d):
    out = run_folder(spark, "stream-ingest")
    job = jobs.Ingestion(spark, out)
    in_turn(_messages(spark, d), lambda stream: run_available(stream, job.handle, f"{out}/checkpoint"))
    stored = job.events.rows().select(
        F.lit("event").alias("kind"), "source", F.col("external_event_id").alias("id"),
        F.col("payload").alias("content"),
    )
    letters = job.dead_letters.rows().select(
        F.lit("dead letter").alias("kind"), F.col("topic").alias("source"),
        F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("id"),
        F.col("error").alias("content"),
    )
    return stored.unionByName(letters)


@query(
    "stream_dedupe",
    with_inputs(["fx_messages"], MESSAGES + "SELECT DISTINCT source, external_event_id FROM good"),
)
def stream_dedupe(spark, d):
    """Every id once, for ever: each micro-batch is compared with all that is stored."""
    out = run_folder(spark, "stream-dedupe")
    job = jobs.Ingestion(spark, out)
    in_turn(_messages(spark, d), lambda stream: run_available(stream, job.handle, f"{out}/checkpoint"))
    return job.events.rows().select("source", "external_event_id")


@query(
    "stream_auto_resolve",
    with_inputs(["fx_breaks", "fx_new_events"], CLOSED + "SELECT break_id, 'RESOLVED' AS status, 'AUTO' AS resolution_type FROM closed"),
)
def stream_auto_resolve(spark, d):
    out = run_folder(spark, "stream-resolve")
    arriving = in_micro_batches(view(spark, d, "fx_new_events"), "ord")
    job = jobs.Ingestion(
        spark, out, breaks=view(spark, d, "fx_breaks"), tolerance_seconds=TOLERANCE, now=lambda: NOW
    )
    in_turn(arriving, lambda stream: run_available(stream, job.resolve, f"{out}/checkpoint"))
    return job.transitions.rows().select("break_id", "status", "resolution_type")


#: Rows wait five minutes more than their own time; the clock stays twenty days behind the latest.
LATENESS = "20 days 1 second"
_LATE_US = (20 * 86_400 + 1) * 1_000_000

# The clock after each micro-batch, and the first micro-batch after which a row's time is over (99: none).
_CLOCK = f""",
clock AS (SELECT batch, max(max(epoch_us(ts))) OVER (ORDER BY batch) - {_LATE_US} AS now FROM fx_arriving GROUP BY batch),
a AS (SELECT r.*, coalesce((SELECT min(c.batch) FROM clock c WHERE c.batch >= r.batch AND c.now > epoch_us(r.ts) + {TOLERANCE}000000), 99) AS over
  FROM fx_arriving r),
l AS (SELECT * FROM a WHERE side = 0), e AS (SELECT * FROM a WHERE side = 1),
met AS (SELECT l.ord AS l_ord, e.ord AS e_ord, row_number() OVER (PARTITION BY l.ord ORDER BY greatest(l.batch, e.batch), e.batch, e.ord) AS n
  FROM l JOIN e ON l.reference = coalesce(e.reference, '') AND l.asset = e.asset AND l.amount = coalesce(e.amount, 0)
    AND coalesce(l.counterparty, '') = coalesce(e.counterparty, '') AND greatest(l.batch, e.batch) <= least(l.over, e.over)),
pairs AS (SELECT l_ord, e_ord FROM met WHERE n = 1),
seen AS (SELECT *, max(over) OVER (PARTITION BY reference, amount ORDER BY batch, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM e),
spell AS (SELECT *, sum(CASE WHEN known IS NULL OR known < batch THEN 1 ELSE 0 END) OVER (PARTITION BY reference, amount ORDER BY batch, ord) AS part FROM seen),
copies AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference, amount, part ORDER BY batch, ord) AS n FROM spell) t WHERE n = 2)"""


_MATCH_SQL = with_inputs(["fx_arriving"], _CLOCK + f"""
SELECT 'pair' AS kind, concat(l_ord, '-', e_ord) AS id, 'match' AS by FROM pairs
UNION ALL SELECT 'TIMING_GAP', sha256(concat_ws('|', '{RUN_ID}', 'ledger', ord)), CASE WHEN over < 99 THEN 'clock' ELSE 'close' END
  FROM l WHERE ord NOT IN (SELECT l_ord FROM pairs)
UNION ALL SELECT 'MISSING_ENTRY', sha256(concat_ws('|', '{RUN_ID}', 'external', ord)), CASE WHEN over < 99 THEN 'clock' ELSE 'close' END
  FROM e WHERE ord NOT IN (SELECT e_ord FROM pairs)
UNION ALL SELECT 'DUPLICATE', sha256(concat_ws('|', '{RUN_ID}', 'duplicate', ord)), 'clock' FROM copies""")


def _arriving(spark, d):
    return view(spark, d, "fx_arriving").withColumnRenamed("batch", "_batch").drop("arrive")


def _match_out(pairs: DataFrame, by_clock: DataFrame, at_close: DataFrame) -> DataFrame:
    found = by_clock.withColumn("by", F.lit("clock")).unionByName(at_close.withColumn("by", F.lit("close")))
    return pairs.select(F.lit("pair").alias("kind"), F.concat_ws("-", F.col("l_ord").cast("string"), F.col("e_ord").cast("string")).alias("id"),
                        F.lit("match").alias("by")).unionByName(found.select(F.col("type").alias("kind"), F.col("break_id").alias("id"), "by"))


@query("stream_match", _MATCH_SQL)
def stream_match(spark, d):
    """Pairs, ended rows and copies as they come about; what still waits at the close becomes breaks."""
    out = run_folder(spark, "stream-match")
    job = jobs.IncrementalMatch(spark, out, RUN_ID, RUN_SOURCE, TOLERANCE, delay_seconds=_LATE_US // 1_000_000)
    in_turn(_arriving(spark, d), lambda stream: run_available(stream, job.handle, f"{out}/checkpoint"))
    last = job.clock.read().agg(F.max("batch_id")).first()[0]
    job.close(last, NOW)
    return _match_out(job.pairs.rows(), job.breaks.before(last + 1), job.breaks.part(last + 1))


@query("stream_match_keyed", _MATCH_SQL)
def stream_match_keyed(spark, d):
    """The same from state by key: a row's wait ends by a timer, and nothing is read but the keys that arrive."""
    out = run_folder(spark, "stream-match-keyed")
    in_turn(_arriving(spark, d), lambda stream: written(keyed.match_stream(stream, TOLERANCE, LATENESS), f"{out}/found", f"{out}/checkpoint"))
    found = spark.read.schema(keyed.MATCHED).parquet(f"{out}/found")
    pairs = found.where("kind = 'pair'").select(F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"))
    waiting = keyed.still_waiting(spark, f"{out}/checkpoint")
    return _match_out(pairs, keyed.breaks_of(found, RUN_ID, RUN_SOURCE, TOLERANCE),
                      keyed.breaks_of(keyed.closed(waiting, NOW), RUN_ID, RUN_SOURCE, TOLERANCE))


#: The last tick; nothing else comes with it.
QUIET = "2024-01-01 03:30:00"


@query(
    "stream_escalate",
    with_inputs(["fx_breaks", "fx_commands", "fx_rules"], f""",
opened AS (SELECT b.break_id, epoch_us(b.detected_at) AS opened, coalesce(o.escalation_age_minutes, g.escalation_age_minutes, 60) * 60 AS age
  FROM fx_breaks b LEFT JOIN fx_rules o ON o.source = b.source AND o.asset = b.asset
  LEFT JOIN fx_rules g ON g.source = b.source AND g.asset IS NULL WHERE b.status = 'OPEN'),
closed AS (SELECT b.break_id, epoch_us(b.detected_at) + CAST(length(c.actor) + 600 * (length(coalesce(c.note, '')) % 7) AS BIGINT) * 1000000 AS closed
  FROM fx_commands c JOIN fx_breaks b ON b.break_id = c.break_id)
SELECT o.break_id, 'ESCALATED' AS status, age AS age_seconds, opened + age * 1000000 AS due_us FROM opened o
WHERE opened + age * 1000000 <= epoch_us(TIMESTAMP '{QUIET}')
  AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.break_id = o.break_id AND c.closed < o.opened + o.age * 1000000 AND c.closed <= epoch_us(TIMESTAMP '{QUIET}'))"""),
)
def stream_escalate(spark, d):
    """Open breaks by their rule's deadline, commands that close some, then only the clock."""
    out = run_folder(spark, "stream-escalate")
    breaks = view(spark, d, "fx_breaks")
    opened = breaks.where("status = 'OPEN'").select("break_id", "source", "asset", F.lit("opened").alias("kind"), F.col("detected_at").alias("at"))
    after = F.length("actor") + 600 * (F.length(F.coalesce("note", F.lit(""))) % 7)
    closed = view(spark, d, "fx_commands").join(breaks, "break_id").select(
        "break_id", "source", "asset", F.lit("closed").alias("kind"), (F.col("detected_at") + F.make_dt_interval(secs=after)).alias("at"))
    closed = closed.where(F.col("at") <= F.lit(QUIET).cast("timestamp"))
    changes = in_micro_batches(opened.unionByName(closed), "at").withColumn("_batch", F.least("_batch", F.lit(MICRO_BATCHES - 2)))
    tick = spark.range(1).select(
        F.lit("").alias("break_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("asset"),
        F.lit("tick").alias("kind"), F.lit(QUIET).cast("timestamp").alias("at"), F.lit(MICRO_BATCHES - 1).cast("bigint").alias("_batch"))
    rules = view(spark, d, "fx_rules")
    in_turn(changes.unionByName(tick), lambda stream: written(keyed.escalations(stream, rules), f"{out}/found", f"{out}/checkpoint"))
    return spark.read.schema(keyed.ESCALATED).parquet(f"{out}/found").select(
        "break_id", "status", "age_seconds", (F.col("at_ms") * 1000).alias("due_us"))


# --- One table of breaks ------------------------------------------------------

_TICK = "TIMESTAMP '2024-01-01 00:30:00' + {batch} * INTERVAL '50' MINUTE"

# Breaks that micro-batch 3 detects again are stored if no equal one is open then; so states are found for the others first.
_LIFE = f"""
{{p}}_ruled AS (SELECT b.*, coalesce(o.tolerance_seconds, g.tolerance_seconds, 300) AS tolerance, coalesce(o.escalation_age_minutes, g.escalation_age_minutes, 60) AS minutes,
    coalesce(o.auto_resolve_timing, g.auto_resolve_timing, true) AS auto
  FROM ({{rows}}) b LEFT JOIN fx_rules o ON o.source = b.source AND o.asset = b.asset LEFT JOIN fx_rules g ON g.source = b.source AND g.asset IS NULL),
{{p}}_event AS (SELECT b.break_id, min(e.ord) AS ord FROM {{p}}_ruled b JOIN fx_loop_events e ON b.source = e.source AND b.asset = e.asset
    AND coalesce(b.internal_amount, 0) = coalesce(e.amount, 0) AND e.batch >= b.batch
  WHERE b.classification = 'TIMING' AND b.auto AND (e.reference IS NULL OR b.reference = e.reference)
    AND (e.ts IS NULL OR abs(epoch_us(b.detected_at) - epoch_us(e.ts)) <= b.tolerance * 1000000) GROUP BY b.break_id),
{{p}}_tick AS (SELECT b.break_id, min(t.ord) AS ord FROM {{p}}_ruled b JOIN ticks t ON t.batch >= b.batch
    AND epoch_us(b.detected_at) + b.minutes * 60000000 <= epoch_us(t.at) GROUP BY b.break_id),
{{p}}_command AS (SELECT c.* FROM fx_loop_commands c JOIN {{p}}_ruled b ON b.break_id = c.break_id AND c.batch >= b.batch),
{{p}}_first AS (SELECT b.break_id, CASE WHEN b.status = 'OPEN' THEN least(coalesce(e.ord, {{never}}), coalesce(t.ord, {{never}}), coalesce(c.ord, {{never}})) END AS ord,
    e.ord AS e_ord, t.ord AS t_ord FROM {{p}}_ruled b LEFT JOIN {{p}}_event e ON e.break_id = b.break_id LEFT JOIN {{p}}_tick t ON t.break_id = b.break_id
  LEFT JOIN (SELECT break_id, min(ord) AS ord FROM {{p}}_command GROUP BY break_id) c ON c.break_id = b.break_id),
{{p}}_steps AS (
  SELECT break_id, ord, 'detected' AS what FROM {{p}}_ruled
  UNION ALL SELECT break_id, ord, CASE WHEN ord = e_ord THEN 'auto' ELSE 'tick' END FROM {{p}}_first WHERE ord = e_ord OR ord = t_ord
  UNION ALL SELECT break_id, ord, action FROM {{p}}_command),
{{p}}_timed AS (SELECT s.*, s.ord // 10000000000000 AS batch, b.detected_at, b.age_seconds AS age0, b.status AS status0, b.resolved_at AS resolved0,
    ({_TICK.format(batch="(s.ord // 10000000000000)")}) - CASE WHEN s.what = 'tick' THEN INTERVAL '0' SECOND ELSE INTERVAL '60' SECOND END AS at
  FROM {{p}}_steps s JOIN {{p}}_ruled b ON b.break_id = s.break_id),
{{p}}_state AS (SELECT m.upto, break_id,
    CASE max_by(what, t.ord) WHEN 'detected' THEN any_value(status0) WHEN 'auto' THEN 'RESOLVED' WHEN 'resolve' THEN 'RESOLVED' ELSE 'ESCALATED' END AS status,
    coalesce(max_by(CASE WHEN what = 'auto' THEN 0 ELSE {AGE_SQL.format(now="t.at", a="t")} END, t.ord) FILTER (what IN ('auto', 'tick', 'escalate')), any_value(age0)) AS age_seconds,
    coalesce(epoch_us(any_value(resolved0)), min(epoch_us(t.at)) FILTER (what IN ('auto', 'resolve'))) AS resolved_us
  FROM {{p}}_timed t JOIN (SELECT b AS upto FROM range(4) r(b)) m ON t.batch <= m.upto GROUP BY m.upto, break_id)"""
_NEVER = "9223372036854775807"
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("type", "source", "asset", "reference", "internal_amount", "external_amount"))

_STATES = f""",
ticks AS (SELECT b AS batch, {_TICK.format(batch="b")} AS at, b * 10000000000000 + 9000000000000 AS ord FROM range(4) r(b)),
""" + _LIFE.format(p="one", rows="SELECT * FROM fx_loop_breaks WHERE batch < 3", never=_NEVER) + """,
again AS (SELECT * FROM fx_loop_breaks a WHERE a.batch = 3 AND NOT EXISTS (SELECT 1 FROM fx_loop_breaks b JOIN one_state s
  ON s.break_id = b.break_id AND s.upto = 2 AND s.status = 'OPEN' WHERE """ + _SAME + """)),
""" + _LIFE.format(p="two", rows="SELECT * FROM again", never=_NEVER) + """,
states AS (SELECT * FROM one_state UNION ALL SELECT * FROM two_state)"""


def _loop(spark, d, out: str) -> break_table.SharedBreaks:
    """Breaks of runs, events, commands and ticks through one table, in four micro-batches with a snapshot after every second."""
    def at(batch, early=60):
        minutes = 30 + 50 * batch
        return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"), secs=F.lit(-early))

    def rows(kind, name, field, schema):
        own = view(spark, d, name)
        part = F.struct(*[F.col(c) if c in own.columns else F.lit(None).alias(c) for c in schemas.columns(schema)])
        return own.select(*break_table.change(kind, at(F.col("batch")), F.col("ord"), **{field: part}), F.col("batch").cast("bigint").alias("_batch"))

    ticks = spark.range(MICRO_BATCHES).select(
        *break_table.change("tick", at(F.col("id"), 0), F.expr("id * 10000000000000 + 9000000000000")), F.col("id").alias("_batch"))
    changes = (
        rows("break", "fx_loop_breaks", "b", schemas.BREAK).unionByName(rows("event", "fx_loop_events", "e", schemas.EXTERNAL))
        .unionByName(rows("command", "fx_loop_commands", "c", break_table.COMMAND)).unionByName(ticks)
    )
    job = break_table.SharedBreaks(spark, out, materialise(view(spark, d, "fx_rules")), compact_every=2, buckets=8)
    in_turn(changes, lambda stream: run_available(stream, job.handle, f"{out}/checkpoint"))
    return job


@query(
    "shared_breaks",
    with_inputs(["fx_loop_breaks", "fx_loop_events", "fx_loop_commands", "fx_rules"], _STATES + """
SELECT upto, break_id, status, age_seconds, resolved_us FROM states"""),
)
def shared_breaks(spark, d):
    """Runs, ingestion, commands and escalation share one table: its states at three past times and its last one.

    A past state is read from the nearest snapshot and the versions since.
    """
    table = _loop(spark, d, run_folder(spark, "shared-breaks")).table
    past = [table.state_at(datetime(2024, 1, 1, 0, 45, tzinfo=timezone.utc) + timedelta(minutes=50 * n)) for n in range(MICRO_BATCHES - 1)]
    states = [
        state.select(F.lit(n).cast("bigint").alias("upto"), "break_id", "status", "age_seconds", us("resolved_at", "resolved_us"))
        for n, state in enumerate([*past, table.state()])
    ]
    return states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3])
