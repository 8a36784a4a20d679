"""Jobs whose state is kept by key in the state store, with timers in event time.

What a micro-batch reads and writes follows its own rows: waiting rows and
deadlines stay in the state store, nothing is written anew. The clock is the
watermark. It is declared on a copy of the time column that is dropped before
the stateful step, so that rows behind it are not thrown away: they are
handled, and end at once if their time is over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import schemas
from tallymark.operators import rules as rl
from tallymark.operators.breaks import as_column, duplicate_breaks, leftover_breaks
from tallymark.operators.matching import ENTRY, with_match_keys
from tallymark.streaming.processors import with_state

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LEDGER_SIDE = 0

_ENTRY = T.StructType([T.StructField(c, schemas.EXTERNAL[c].dataType) for c in ENTRY])
#: As the processor has it: instants are microseconds there.
_PLAIN = T.StructType([T.StructField(f.name, T.LongType() if f.name == "ts" else f.dataType) for f in _ENTRY.fields])
MATCHED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("l", _ENTRY), T.StructField("e", _ENTRY), T.StructField("at_ms", T.LongType()),
])
_FOUND = T.StructType([T.StructField(f.name, _PLAIN if f.dataType == _ENTRY else f.dataType) for f in MATCHED.fields])


def use_state_store(spark: SparkSession) -> None:
    """Keyed state on disk; each micro-batch uploads its changes only.

    All partitions of an executor share one bound of memory, and those of a
    query that has ended are let go within seconds: else the memory follows the
    number of partitions and of restarts.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "15s")
    # Else each write asks first whether the key is there, to count the rows for a metric.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


def on_the_clock(rows: DataFrame, time: Column, delay: str = "0 seconds") -> DataFrame:
    """The stream with a watermark on `time`, which no row is dropped for.

    A time after now counts as none: a row dated in the future moves no clock.
    """
    clock = F.when(time <= F.current_timestamp(), time)
    return rows.withColumn("_clock", clock).withWatermark("_clock", delay).drop("_clock")


def match_stream(ledger_and_events: DataFrame, patience_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Pairs, second copies and rows that nobody came for, as a stream of `MATCHED`.

    Input: the rows of `side_by_side`. A row waits until the watermark has
    passed its time by `patience_seconds`; without a time it waits for good.
    An event is a copy while the watermark has not passed the latest of the
    copies before it by as much. How rows meet is told in `Pairing.java`.
    """
    use_state_store(ledger_and_events.sparkSession)
    rows = on_the_clock(with_match_keys(ledger_and_events), F.col("ts"), delay)
    rows = rows.withColumn("deadline", F.expr(f"unix_millis(ts) + {patience_seconds * 1000}L")).withColumn("ts", F.unix_micros("ts"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _PLAIN.fields)
    found = with_state(rows, ["k_ref", "k_amount"], ["side", "k_asset", "k_party", "deadline", *ENTRY], "Pairing", _FOUND, "EventTime",
                       ddl, len(ENTRY), ENTRY.index("reference"), ENTRY.index("amount"))
    return found.select("kind", *[F.col(c).withField("ts", F.timestamp_micros(f"{c}.ts")).alias(c) for c in ("l", "e")], "at_ms")


def breaks_of(found: DataFrame, run_id: str, source: str, tolerance_seconds: int) -> DataFrame:
    """Breaks of what `match_stream` gives out; detected when the watermark said so."""
    at = F.timestamp_millis("at_ms")
    left = leftover_breaks(found.where("kind = 'ended'"), F.lit(run_id), F.lit(source), at, tolerance_seconds)
    copies = found.where("kind = 'DUPLICATE'").select("e.*", "at_ms")
    return left.unionByName(duplicate_breaks(copies, F.lit(run_id), at))


def still_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows that wait after the last micro-batch, from the state store: side and entry."""
    use_state_store(spark)
    state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    return state.select("user_map_value.*").drop("deadline").withColumn("ts", F.timestamp_micros("ts"))


def closed(waiting: DataFrame, now: datetime) -> DataFrame:
    """End of the day: what still waits, in the shape of `MATCHED`."""
    entry = F.struct(*[F.col(c).cast(schemas.EXTERNAL[c].dataType).alias(c) for c in ENTRY])
    is_ledger = F.col("side") == _LEDGER_SIDE
    return waiting.select(F.lit("ended").alias("kind"), F.when(is_ledger, entry).alias("l"), F.when(~is_ledger, entry).alias("e"),
                          F.unix_millis(as_column(now)).alias("at_ms"))


# --- Deadlines of breaks -----------------------------------------------------

ESCALATED = "break_id string, status string, age_seconds bigint, at_ms bigint"


def escalations(changes: DataFrame, rules: DataFrame | None = None, minutes: int = schemas.DEFAULT_ESCALATION_MINUTES,
                delay: str = "0 seconds", time_mode: str = "EventTime") -> DataFrame:
    """Escalations as a stream, one per break at most, at the very time they are due.

    A break escalates unless it has left OPEN before its time; see `Deadlines.java`.
    `changes` is a stream of (break_id, source, asset, kind, at): `opened`, `closed`, or
    `tick`, which only moves the clock of a quiet stream. Deadlines follow the
    rule of source and asset. With `ProcessingTime` timers need no ticks, but
    come with the wall clock.
    """
    use_state_store(changes.sparkSession)
    rows = on_the_clock(changes, F.col("at"), delay)
    default = F.lit(minutes).cast("bigint")
    if rules is None:
        rows = rows.withColumn("escalation_age_minutes", default)
    else:
        rows = rl.with_rule_value(rows, rules, "escalation_age_minutes", default)
    # Ticks must not be filtered out here: the filter would move below the watermark, and the clock would stand still.
    rows = rows.select(
        "break_id", "kind", F.unix_millis("at").alias("at_ms"), F.col("escalation_age_minutes").alias("minutes"))
    return with_state(rows, ["break_id"], ["kind", "at_ms", "minutes"], "Deadlines", T.StructType.fromDDL(ESCALATED), time_mode)
