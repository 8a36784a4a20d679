"""Streaming jobs: ingestion, auto-resolution, incremental matching, escalation.

Sources deliver at least once; every job leaves the same tables when a
micro-batch is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import schemas
from tallymark.operators import events, lifecycle
from tallymark.operators.breaks import duplicate_breaks, leftover_breaks
from tallymark.operators.matching import pair_exact, side_by_side, with_match_keys
from tallymark.sources import messages as msg
from tallymark.streaming.id_index import KEY, IdIndex
from tallymark.streaming.message_sink import send
from tallymark.streaming.store import PART, KeyedTable, Table, at_once

DEAD_LETTER = T.StructType([*schemas.MESSAGE.fields, T.StructField("error", T.StringType())])
TRANSITION = T.StructType(
    [
        *schemas.BREAK.fields,
        T.StructField("before_status", T.StringType()),
        T.StructField("before_age", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("resolution_type", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)
_STORED = T.StructType([*schemas.EXTERNAL_EVENT.fields, T.StructField("ingested_at", T.TimestampType())])
_LANDED = T.StructType(
    [
        *DEAD_LETTER.fields,
        T.StructField("source", T.StringType()),
        T.StructField("external_event_id", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)
_ENTRY = T.StructType([T.StructField("side", T.IntegerType()), *schemas.EXTERNAL.fields])
_SIDE = T.StructType([*schemas.EXTERNAL.fields, T.StructField("copy", T.LongType())])
_PAIRING = T.StructType([T.StructField("l", _SIDE), T.StructField("e", _SIDE)])
_PAIR = T.StructType([T.StructField("l_ord", T.LongType()), T.StructField("e_ord", T.LongType())])
_COPIES = T.StructType([T.StructField("n", T.LongType()), T.StructField("latest", T.TimestampType())])
_CLOCK = T.StructType([T.StructField("latest", T.TimestampType())])


def read_landed_messages(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Messages landed as JSON files, one per line."""
    reader = spark.readStream.schema(schemas.MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def kafka_messages(stream: DataFrame) -> DataFrame:
    """Rows of a Kafka source in the message shape."""
    return stream.select(
        "topic", "partition", "offset",
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
    )


def drop_redelivered(events: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """Stream of events without repeats that arrive within `horizon` of each other.

    State is bounded by the horizon. Where a repeat may come any time later,
    use the event store of `Ingestion`, which compares with all stored ids.
    """
    return events.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(
        ["source", "external_event_id"]
    )


class Ingestion:
    """Messages to stored events and dead letters; new events close timing breaks.

    A micro-batch is parsed once and landed; what follows reads the landed part.
    Which ids are stored is asked of an index that opens the buckets of the
    arriving ids only, and forgets none.
    """

    def __init__(
        self,
        spark: SparkSession,
        out: str,
        breaks: DataFrame | None = None,
        tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
        auto_resolve: bool = schemas.DEFAULT_AUTO_RESOLVE,
        now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    ):
        self.landed = Table(spark, f"{out}/landed", _LANDED).create()
        self.events = Table(spark, f"{out}/events", _STORED).create()
        self.ids = IdIndex(spark, f"{out}/ids")
        self.dead_letters = Table(spark, f"{out}/dead_letters", DEAD_LETTER).create()
        self.transitions = Table(spark, f"{out}/transitions", TRANSITION).create()
        self.breaks = breaks
        self.tolerance_seconds, self.auto_resolve, self.now = tolerance_seconds, auto_resolve, now

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.landed.put(msg.prepare(batch), batch_id)
        prepared = self.landed.part(batch_id)
        self.dead_letters.put(msg.dead_letters(prepared), batch_id)
        arrived = msg.first_of_each(msg.events_of(prepared))
        fresh = arrived.join(self.ids.known(arrived, batch_id), KEY, "left_anti")
        self.events.put(fresh.withColumn("ingested_at", F.lit(self.now()).cast("timestamp")), batch_id)
        self.ids.add(batch_id, self.events.part(batch_id))
        if self.breaks is not None and self.auto_resolve:
            arrived = msg.external_entries(self.events.part(batch_id))
            self.resolve(arrived, batch_id)

    def listed(self, source: str | None = None, limit: int | None = None) -> DataFrame:
        """Stored events as they were ingested: by micro-batch, then by position in it.

        Offsets of different partitions are never compared across micro-batches.
        """
        rows = self.events.read()
        if source is not None:
            rows = rows.where(F.col("source") == source)
        rows = rows.orderBy(PART, "ord").drop(PART)
        return rows if limit is None else rows.limit(limit)

    def state(self) -> DataFrame:
        """The breaks as they are now."""
        log = self.transitions.read().withColumnRenamed("batch_id", "step")
        return lifecycle.current_state(self.breaks, log)

    def audits(self) -> DataFrame:
        """Audit messages of all breaks that events have closed."""
        return events.as_audit_messages(lifecycle.audits_of(self.transitions.rows()))

    def dead_letter_messages(self) -> DataFrame:
        return events.dead_letter_messages(self.dead_letters.rows())

    def send(self, path: str, batch_id: int) -> None:
        """Dead letters and audits of a micro-batch to their topics, once however often it is tried."""
        letters = events.dead_letter_messages(self.dead_letters.part(batch_id))
        audits = events.as_audit_messages(lifecycle.audits_of(self.transitions.part(batch_id)))
        send(letters.unionByName(audits), path, f"batch-{batch_id}")

    def resolve(self, arrived: DataFrame, batch_id: int) -> None:
        closed = self.transitions.before(batch_id).select("break_id")
        still_open = self.breaks.join(closed, "break_id", "left_anti")
        moved = lifecycle.auto_resolve(still_open, arrived, self.now(), self.tolerance_seconds)
        self.transitions.put(moved, batch_id)


class IncrementalMatch:
    """Exact pairing of ledger rows and events as they arrive.

    Rows of a micro-batch are matched together with the rows still waiting that
    share their reference and amount, by the same operator as a batch run. A
    row waits until the newest time seen has passed its own by the tolerance
    plus the allowed delay; then it becomes a break. Rows without a time wait
    until `close`. The clock never passes the time of arrival, so that a row
    dated in the future ends nobody's wait. An event is a duplicate if it is the
    second with its stored reference and amount while copies are remembered,
    which is as long as the latest of them could wait.

    Waiting rows and counts of copies are keyed tables: a micro-batch writes
    what it changes and nothing else. They are read for each (by columns, in
    one scan), since any row's wait may end.
    """

    def __init__(
        self,
        spark: SparkSession,
        out: str,
        run_id: str,
        source: str,
        tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
        delay_seconds: int = 0,
        now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    ):
        self.now = now
        self.pairing = Table(spark, f"{out}/pairing", _PAIRING).create()
        self.pairs = Table(spark, f"{out}/pairs", _PAIR).create()
        self.waiting = KeyedTable(spark, f"{out}/waiting", _ENTRY, once=True)
        self.copies = KeyedTable(spark, f"{out}/copies", _COPIES)
        self.breaks = Table(spark, f"{out}/breaks", schemas.BREAK).create()
        self.clock = Table(spark, f"{out}/clock", _CLOCK).create()
        self.run_id, self.source = F.lit(run_id), F.lit(source)
        self.tolerance_seconds = tolerance_seconds
        self.patience = timedelta(seconds=tolerance_seconds + delay_seconds)

    @staticmethod
    def input(ledger: DataFrame, external: DataFrame) -> DataFrame:
        """Both streams as one, so that one query keeps them in step."""
        return side_by_side(ledger, external)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*_ENTRY.names)
        arrived = F.lit(self.now()).cast("timestamp")
        newest = rows.agg(F.max(F.when(F.col("ts") <= arrived, F.col("ts")))).first()[0]
        before = self.clock.part(batch_id - 1).agg(F.max("latest")).first()[0]
        latest = max((t for t in (newest, before) if t is not None), default=None)
        waiting = self.waiting.state(batch_id - 1)
        place = ["k_ref", "k_amount"]
        asked = with_match_keys(rows).select(*place).distinct()
        touched = with_match_keys(waiting).join(asked, place, "left_semi").select(*_ENTRY.names)
        both = rows.unionByName(touched)
        ledger = both.where("side = 0").select(*schemas.columns(schemas.LEDGER))
        external = both.where("side = 1").drop("side")
        # All results are read from the pairing; it is written once.
        copies, second = self._copies(rows.where("side = 1").drop("side"), batch_id, before)
        clock = self.pairing.spark.createDataFrame([(latest,)], _CLOCK)
        pairs = pair_exact(ledger, external)
        at_once(lambda: self.pairing.put(pairs, batch_id), lambda: self.copies.commit(batch_id, *copies), lambda: self.clock.put(clock, batch_id))
        pairing = self.pairing.part(batch_id)
        paired = pairing.where("l IS NOT NULL AND e IS NOT NULL")
        entry = F.coalesce("l", "e")
        side = F.when(F.col("l").isNotNull(), 0).otherwise(1)
        alone = _with_key(pairing.where("(l IS NULL) <> (e IS NULL)").select(side.alias("side"), entry.alias("x")).select("side", "x.*"))
        over = F.lit(False) if latest is None else F.coalesce(F.col("ts") < F.lit(latest - self.patience), F.lit(False))
        met = paired.select(F.explode(F.array(F.concat(F.lit("0:"), "l.ord"), F.concat(F.lit("1:"), "e.ord"))).alias("key"))
        settled = met.unionByName(alone.select("key"))
        ended = alone.where(over).select(*_ENTRY.names).unionByName(
            waiting.where(over).join(settled, "key", "left_anti").select(*_ENTRY.names))
        fresh = alone.where(~over).join(_with_key(rows).select("key"), "key", "left_semi")
        at_once(
            lambda: self.pairs.put(paired.select(F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord")), batch_id),
            lambda: self._to_breaks(_one_sided(ended), batch_id, latest, second),
            lambda: self.waiting.commit(batch_id, fresh, met.unionByName(_with_key(ended).select("key"))),
        )

    def _copies(self, events: DataFrame, batch_id: int, before: datetime | None) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
        """New counts by reference and amount (null equal to null) with keys to forget, and the events that are second."""
        named = events.withColumn("key", F.to_json(F.struct("reference", "amount"), {"ignoreNullFields": "false"}))
        state = self.copies.state(batch_id - 1)
        forgotten = F.lit(False) if before is None else F.coalesce(F.col("latest") < F.lit(before - self.patience), F.lit(False))
        kept = state.where(~forgotten).select("key", F.col("n").alias("_n"), F.col("latest").alias("_latest"), F.lit(True).alias("_known"))
        first = Window.partitionBy("key").orderBy("ord")
        two = named.withColumn("_place", F.row_number().over(first)).where("_place <= 2")
        # An event without a time has no end: the copies of its key are remembered for good.
        counts = named.groupBy("key").agg(
            F.count("*").alias("n"), F.when(F.count("ts") == F.count("*"), F.max("ts")).alias("latest"))
        endless = F.col("latest").isNull() | (F.col("_known") & F.col("_latest").isNull())
        merged = counts.join(kept, "key", "left").select(
            "key", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.when(~F.coalesce(endless, F.lit(False)), F.greatest("latest", "_latest")).alias("latest"))
        # What is over is left out of the snapshots; until then it is passed over.
        last = (batch_id + 1) % self.copies.compact_every == 0
        old = state.where(forgotten).select("key").join(counts, "key", "left_anti") if last else counts.select("key").limit(0)
        second = two.join(kept, "key", "left").where(F.col("_place") + F.coalesce("_n", F.lit(0)) == 2)
        return (merged, old), second.select(*schemas.columns(schemas.EXTERNAL))

    def _to_breaks(self, alone: DataFrame, batch_id: int, now: datetime | None, second: DataFrame | None = None) -> None:
        at = F.lit(now).cast("timestamp")
        found = leftover_breaks(alone, self.run_id, self.source, at, self.tolerance_seconds)
        if second is not None:
            found = found.unionByName(duplicate_breaks(second, self.run_id, at))
        self.breaks.put(found, batch_id)

    def close(self, last_batch_id: int, now: datetime) -> None:
        """End of the day: what still waits becomes breaks."""
        self._to_breaks(_one_sided(self.waiting.state(last_batch_id)), last_batch_id + 1, now)


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat_ws(":", F.col("side").cast("string"), F.col("ord").cast("string")))


def _one_sided(rows: DataFrame) -> DataFrame:
    entry = F.struct(*[F.col(c) for c in _ENTRY.names if c != "side"])
    return rows.select(F.when(F.col("side") == 0, entry).alias("l"), F.when(F.col("side") == 1, entry).alias("e"))


class Escalation:
    """Breaks as they are detected; each trigger escalates those that are due.

    A trigger comes with new breaks only. `tick`, run on a schedule, escalates
    what has become due in a quiet stream.
    """

    def __init__(
        self,
        spark: SparkSession,
        out: str,
        minutes: int = schemas.DEFAULT_ESCALATION_MINUTES,
        now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    ):
        self.breaks = Table(spark, f"{out}/breaks", schemas.BREAK).create()
        self.transitions = Table(spark, f"{out}/transitions", TRANSITION).create()
        self.timed = Table(spark, f"{out}/timed", TRANSITION).create()
        self.minutes, self.now = minutes, now

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.breaks.put(batch, batch_id)
        done = self.transitions.before(batch_id).unionByName(self.timed.rows())
        self._escalate(self.breaks.before(batch_id + 1), done, self.transitions, batch_id)

    def tick(self) -> None:
        """Escalates by the clock alone; repeated within a microsecond, it replaces its own part."""
        part = int(self.now().timestamp() * 1_000_000)
        done = self.transitions.rows().unionByName(self.timed.before(part))
        self._escalate(self.breaks.rows(), done, self.timed, part)

    def _escalate(self, breaks: DataFrame, done: DataFrame, into: Table, part: int) -> None:
        known = breaks.join(done.select("break_id"), "break_id", "left_anti")
        into.put(lifecycle.escalate_stale(known, self.now(), self.minutes), part)

    def all_transitions(self) -> DataFrame:
        return self.transitions.rows().unionByName(self.timed.rows())

    def alerts(self) -> DataFrame:
        """Alert messages of all escalations."""
        return events.as_messages(lifecycle.alerts_of(self.all_transitions()))
