"""One table of breaks that runs, events, commands and the clock read and change.

The table is a log of versions, one part per commit, with snapshots. A state is
the nearest snapshot before it and the versions since: what is read follows the
number of open breaks and recent changes, not the history. A commit that is
repeated replaces its own part; parts without the writer's mark of success do
not count.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import schemas
from tallymark.functions.scalars import age_seconds
from tallymark.operators import lifecycle as lc
from tallymark.operators import rules as rl
from tallymark.operators.breaks import as_column
from tallymark.operators.checks import new_breaks_only
from tallymark.session import materialise
from tallymark.streaming.jobs import TRANSITION
from tallymark.streaming.store import Table, numbered

_BREAK = schemas.columns(schemas.BREAK)
#: A transition and its place among those of its commit.
VERSION = T.StructType([*TRANSITION.fields, T.StructField("seq", T.LongType())])
_STATE = T.StructType([*schemas.BREAK.fields, T.StructField("open", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
_TIMES = T.StructType([T.StructField("commit", T.LongType()), T.StructField("low", T.TimestampType()), T.StructField("high", T.TimestampType())])
#: Commits in one folder of the log; a reader lists the folders since its snapshot only.
EPOCH = 1000
BUCKETS = 64


class BreakTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- Folders ---

    def _epoch(self, commit: int) -> str:
        return f"{self.path}/log/epoch={commit // EPOCH}"

    def commits(self, after: int = -1, upto: int | None = None) -> list[int]:
        """Commits in (after, upto], from the folders that can have them."""
        epochs = [e for e in numbered(self.spark, f"{self.path}/log", "epoch", finished=False) if e >= (after + 1) // EPOCH and (upto is None or e <= upto // EPOCH)]
        found = (n for e in epochs for n in numbered(self.spark, f"{self.path}/log/epoch={e}", "commit"))
        return [n for n in found if n > after and (upto is None or n <= upto)]

    def snapshots(self) -> list[int]:
        return numbered(self.spark, f"{self.path}/snapshots", "commit")

    # --- Writing ---

    def commit(self, n: int, versions: DataFrame) -> None:
        """Adds versions (with `seq`) as commit n, or replaces what an earlier attempt of it wrote."""
        place = f"{self._epoch(n)}/commit={n}"
        versions.select(*VERSION.names).write.mode("overwrite").parquet(place)
        span = self.spark.read.schema(VERSION).parquet(place).agg(F.min("at").alias("low"), F.max("at").alias("high"))
        span.select(F.lit(n).cast("bigint").alias("commit"), "low", "high").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/times/epoch={n // EPOCH}/commit={n}")

    def compact(self, upto: int | None = None) -> None:
        """Writes the state after the last commit as a snapshot, open breaks apart from others, by bucket of the id."""
        done = self.commits(upto=upto)
        if not done:
            return
        # A snapshot that is written again must not read itself.
        since = max((s for s in self.snapshots() if s < done[-1]), default=-1)
        state = self.state(upto, since=since).withColumn("open", F.col("status") == "OPEN").withColumn("bucket", self._bucket("break_id"))
        state.repartition("open", "bucket").write.mode("overwrite").partitionBy("open", "bucket").parquet(
            f"{self.path}/snapshots/commit={done[-1]}")

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    # --- Reading ---

    def versions(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Versions of commits in (after, upto], with `commit`; other parts are not opened."""
        parts = [self.spark.read.schema(VERSION).parquet(f"{self._epoch(n)}/commit={n}").withColumn("commit", F.lit(n).cast("bigint"))
                 for n in self.commits(after, upto)]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*VERSION.fields, T.StructField("commit", T.LongType())]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def state(self, upto: int | None = None, open_only: bool = False, ids: DataFrame | None = None, since: int | None = None,
              until: datetime | None = None) -> DataFrame:
        """Breaks as they are after commit `upto`, or now.

        `open_only` leaves the snapshot's other breaks unread; `ids` (break_id)
        opens only the buckets that these ids fall into. `since` names the
        snapshot to start from, `until` passes over later versions.
        """
        if since is None:
            since = max((s for s in self.snapshots() if upto is None or s <= upto), default=-1)
        tail = self.versions(since, upto)
        if until is not None:
            tail = tail.where(F.col("at") <= as_column(until))
        if ids is not None:
            tail = tail.join(ids.select("break_id").distinct(), "break_id", "left_semi")
        latest = Window.partitionBy("break_id").orderBy(F.desc("commit"), F.desc("seq"))
        changed = tail.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*_BREAK)
        kept = changed.where("status = 'OPEN'") if open_only else changed
        if since < 0:
            return kept
        base = self.spark.read.schema(_STATE).parquet(f"{self.path}/snapshots/commit={since}")
        if open_only:
            base = base.where("open")
        if ids is not None:
            # At most as many numbers as there are buckets.
            touched = [r.bucket for r in ids.select(self._bucket("break_id").alias("bucket")).distinct().collect()]
            base = base.where(F.col("bucket").isin(touched)).join(ids.select("break_id").distinct(), "break_id", "left_semi")
        return base.select(*_BREAK).join(changed.select("break_id"), "break_id", "left_anti").unionByName(kept)

    def state_at(self, time: datetime) -> DataFrame:
        """Breaks as they were at a time: the last snapshot whose versions are all as old, and the versions up to then."""
        known = self.spark.createDataFrame([], _TIMES)
        if self.commits():
            known = self.spark.read.schema(_TIMES).option("recursiveFileLookup", "true").parquet(f"{self.path}/times")
        at = as_column(time)
        late = known.where(F.col("high") > at).agg(F.min("commit").alias("n")).first().n
        last = known.where(F.col("low") <= at).agg(F.max("commit").alias("n")).first().n
        if last is None:
            return self.spark.createDataFrame([], schemas.BREAK)
        since = max((s for s in self.snapshots() if late is None or s < late), default=-1)
        return self.state(max(last, since), since=since, until=time)


# --- What changes it -----------------------------------------------------------

COMMAND = T.StructType([T.StructField(n, T.StringType()) for n in ("break_id", "action", "actor", "note")])
ACTIONS = {"resolve": "RESOLVED", "escalate": "ESCALATED"}
CHANGE = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampType()),
    T.StructField("b", schemas.BREAK), T.StructField("e", schemas.EXTERNAL), T.StructField("c", COMMAND),
])


def change(kind: str, at: Column, ord: Column, **parts: Column) -> list[Column]:
    """A row of `CHANGE`: kind is break, event, command or tick."""
    given = {"ord": ord, "kind": F.lit(kind), "at": at, **parts}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields]


class SharedBreaks:
    """Micro-batches of changes, applied to one table of breaks.

    A micro-batch's new breaks come first; then its events, commands and ticks
    in their order. An event closes the open timing breaks that it agrees with,
    where the rule of their source and asset allows it and within that rule's tolerance;
    a tick escalates open breaks that are old enough by their rule; commands
    apply whatever the status. A break that agrees with one still open is not
    stored again. The state read is that of earlier commits, so a micro-batch
    that is repeated does the same.
    """

    def __init__(self, spark: SparkSession, out: str, rules: DataFrame, compact_every: int | None = None, buckets: int = BUCKETS):
        self.table = BreakTable(spark, f"{out}/breaks", buckets)
        self.landed = Table(spark, f"{out}/landed", CHANGE).create()
        self.rules, self.compact_every = rules, compact_every

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.landed.put(batch, batch_id)
        rows = self.landed.part(batch_id)
        self.table.commit(batch_id, self._versions(rows, batch_id))
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.table.compact(batch_id)

    def _versions(self, rows: DataFrame, batch_id: int) -> DataFrame:
        before = batch_id - 1
        commands = rows.where("kind = 'command'").select("ord", "at", "c.*")
        # Written once each: they are read several times below, and plans stay short.
        is_open = materialise(self.table.state(before, open_only=True))
        others = self.table.state(before, ids=commands).where("status <> 'OPEN'")
        found = materialise(self._new(rows, is_open, before))
        known = is_open.unionByName(others).unionByName(found.select(*_BREAK))
        left = materialise(self._left_open(known.where("status = 'OPEN'"), rows, commands))
        targets = known.join(commands.select("break_id").distinct(), "break_id", "left_semi")
        changed = left.join(commands.select("break_id").distinct(), "break_id", "left_semi")
        state = lc.apply_to(targets, changed)
        return (
            self._version(found.withColumn("before_status", F.lit(None)), "detected", F.lit("system"), F.lit(0), age=F.lit(None))
            .unionByName(left.withColumn("seq", F.lit(1).cast("bigint")).select(*VERSION.names))
            .unionByName(self._commanded(state, commands))
        )

    @staticmethod
    def _version(rows: DataFrame, action: str, actor: Column, seq: Column, age: Column) -> DataFrame:
        given = {"before_age": age, "action": F.lit(action), "actor": actor, "seq": seq}
        return rows.select(*[
            (given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in VERSION.fields])

    def _new(self, rows: DataFrame, is_open: DataFrame, before: int) -> DataFrame:
        """Breaks of runs that are not stored and agree with no open one; with `at`."""
        found = rows.where("kind = 'break'").select("b.*", "at", "ord")
        first = Window.partitionBy("break_id").orderBy("ord")
        found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ord")
        stored = self.table.state(before, ids=found).select("break_id")
        return new_breaks_only(found.join(stored, "break_id", "left_anti"), is_open)

    def _left_open(self, open_breaks: DataFrame, rows: DataFrame, commands: DataFrame) -> DataFrame:
        """The first change that takes each open break out of OPEN, unless a command came before."""
        minutes = F.lit(schemas.DEFAULT_ESCALATION_MINUTES).cast("bigint")
        open_breaks = rl.with_auto_resolve(open_breaks, self.rules).drop("rule_level")
        open_breaks = rl.with_tolerance(open_breaks, self.rules).drop("rule_level")
        open_breaks = rl.with_rule_value(open_breaks, self.rules, "escalation_age_minutes", minutes).drop("rule_level")
        events = rl.with_tolerance(rows.where("kind = 'event'").select("e.*", "at", F.col("ord").alias("_ord")).withColumn("ord", F.col("_ord")), self.rules)
        closing = lc.first_closing_event(open_breaks.where("auto_resolve_timing"), events, F.col("tolerance_seconds"))
        by = events.select("ord", F.col("at").alias("_event_at"), F.col("reference").alias("_event_ref"))
        first_command = commands.groupBy("break_id").agg(F.min("ord").alias("_command"))
        # One per trigger of the schedule; only their times are needed here.
        ticks = sorted((r.ord, r.at) for r in rows.where("kind = 'tick'").select("ord", "at").collect())
        due = F.col("detected_at") + F.make_dt_interval(mins=F.col("escalation_age_minutes").cast("int"))
        tick = F.lit(None).cast("struct<ord: bigint, at: timestamp>")
        for ord, at in reversed(ticks):
            tick = F.when(due <= as_column(at), F.struct(F.lit(ord).cast("bigint").alias("ord"), as_column(at).alias("at"))).otherwise(tick)
        never = F.lit((1 << 63) - 1)
        moved = (
            open_breaks.join(closing.join(by, "ord"), "break_id", "left").withColumnRenamed("ord", "_event")
            .join(first_command, "break_id", "left").withColumn("_tick", tick)
        )
        event, ticked, command = (F.coalesce(c, never) for c in ("_event", F.col("_tick.ord"), "_command"))
        closed = lc.transition(
            moved.where((event < ticked) & (event < command)), F.col("_event_at"), "RESOLVED", F.lit(0), "auto-resolved",
            F.lit("system"), lc.auto_note(F.col("_event_ref")), "AUTO")
        late = moved.where((ticked < event) & (ticked < command))
        return closed.unionByName(lc.transition(
            late, F.col("_tick.at"), "ESCALATED", age_seconds("detected_at", F.col("_tick.at")), "escalated", F.lit("system")))

    def _commanded(self, state: DataFrame, commands: DataFrame) -> DataFrame:
        """All commands on known breaks, one after the other."""
        rows = state.join(commands.where(F.col("action").isin(*ACTIONS)), "break_id")
        upto = Window.partitionBy("break_id").orderBy("ord")
        until_now, earlier = upto.rowsBetween(Window.unboundedPreceding, 0), upto.rowsBetween(Window.unboundedPreceding, -1)
        status = F.create_map(*[F.lit(x) for item in ACTIONS.items() for x in item])[F.col("action")]
        grown = F.when(F.col("action") == "escalate", age_seconds("detected_at", F.col("at")))
        closed = F.when(F.col("action") == "resolve", F.col("at"))
        rows = rows.select(
            *[F.col(c) for c in _BREAK if c not in ("status", "age_seconds", "resolved_at")], "actor", "note", "at",
            status.alias("status"), F.coalesce(F.lag(status).over(upto), "status").alias("before_status"),
            F.coalesce(F.last(grown, True).over(until_now), "age_seconds").alias("age_seconds"),
            F.coalesce(F.last(grown, True).over(earlier), "age_seconds").alias("before_age"),
            F.coalesce("resolved_at", F.min(closed).over(until_now)).alias("resolved_at"),
            F.when(F.col("action") == "resolve", F.lit("manually-resolved")).otherwise(F.lit("escalated")).alias("action"),
            F.lit("MANUAL").alias("resolution_type"), (F.row_number().over(upto) + 1).cast("bigint").alias("seq"),
        )
        return rows.select(*VERSION.names)
