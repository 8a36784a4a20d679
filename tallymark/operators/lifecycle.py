"""Ageing, escalation and resolution of breaks.

An operation returns transitions: break rows in their new state together with
what they were before and who acted. State, resolutions, alerts and audits are
all read from that one frame. Nothing is updated in place: current state is
the old rows without the changed ones, plus the changed ones.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.ranking import null_safe_join
from tallymark.functions.scalars import age_seconds, amount_or_zero, match_money, micros
from tallymark.operators import events
from tallymark.operators.breaks import as_column

_BREAK = schemas.columns(schemas.BREAK)
_CLOSING = ("RESOLVED", "CLOSED")

# --- Fixed text of the resolution row written by auto-resolution ---
AUTO_NOTE = "auto-resolved by external event for {source}/{asset}/{reference}"
MISSING_REFERENCE = "None"


def transition(
    rows: DataFrame,
    now: Column,
    status: Column | str,
    age: Column,
    action: str,
    actor: Column,
    note: Column | None = None,
    resolution: str | None = None,
    before_status: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows in a new state, with what they were before and who acted."""
    new_status = F.lit(status) if isinstance(status, str) else status
    closed_at = F.when(new_status.isin(*_CLOSING), now)
    changed = {
        "status": new_status,
        "age_seconds": age.cast("bigint"),
        "resolved_at": F.coalesce("resolved_at", closed_at),
    }
    return rows.select(
        *[changed.get(c, F.col(c)).alias(c) for c in _BREAK],
        (F.col("status") if before_status is None else before_status).alias("before_status"),
        F.col("age_seconds").alias("before_age"),
        F.lit(action).alias("action"),
        actor.alias("actor"),
        (F.lit(None).cast("string") if note is None else note).alias("note"),
        F.lit(resolution).cast("string").alias("resolution_type"),
        now.alias("at"),
        *keep,
    )


def update_ages(breaks: DataFrame, now: Column | datetime) -> DataFrame:
    """OPEN breaks whose age in whole seconds has changed."""
    at = as_column(now)
    aged = breaks.where("status = 'OPEN'").withColumn("_age", age_seconds("detected_at", at))
    return transition(
        aged.where("_age <> age_seconds"), at, "OPEN", F.col("_age"), "aged", F.lit("system")
    )


def escalate_stale(
    breaks: DataFrame,
    now: Column | datetime,
    minutes: Column | int = schemas.DEFAULT_ESCALATION_MINUTES,
) -> DataFrame:
    """OPEN breaks that reached the escalation age. All of them, not the newest few."""
    at = as_column(now)
    limit = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("bigint") * 60
    age = age_seconds("detected_at", at)
    stale = breaks.where((F.col("status") == "OPEN") & (age >= limit))
    return transition(stale, at, "ESCALATED", age, "escalated", F.lit("system"))


def age_and_escalate(
    breaks: DataFrame,
    now: Column | datetime,
    minutes: Column | int = schemas.DEFAULT_ESCALATION_MINUTES,
) -> DataFrame:
    """All OPEN breaks with their new age and, where it is due, ESCALATED. One pass."""
    at = as_column(now)
    limit = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("bigint") * 60
    aged = breaks.where("status = 'OPEN'").withColumn("_age", age_seconds("detected_at", at))
    due = F.col("_age") >= limit
    moved = aged.where((F.col("_age") != F.col("age_seconds")) | due)
    out = transition(
        moved, at, F.when(due, F.lit("ESCALATED")).otherwise(F.lit("OPEN")), F.col("_age"),
        "aged", F.lit("system"),
    )
    return out.withColumn(
        "action", F.when(F.col("status") == "ESCALATED", F.lit("escalated")).otherwise(F.lit("aged"))
    )


def _commanded(breaks: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands with their break; `_first` marks the first command on it.

    Needs `ord` on the commands. Commands for unknown breaks drop out.
    """
    first = commands.groupBy("break_id").agg(F.min("ord").alias("_first_ord"))
    targets = breaks.join(first, "break_id")
    given = commands.select("break_id", "ord", F.col("actor").alias("_actor"), F.col("note").alias("_note"))
    return targets.join(given, "break_id").withColumn("_first", F.col("ord") == F.col("_first_ord"))


def unknown_commands(breaks: DataFrame, commands: DataFrame) -> DataFrame:
    return commands.join(breaks.select("break_id"), "break_id", "left_anti")


def escalate_manually(breaks: DataFrame, commands: DataFrame, now: Column | datetime) -> DataFrame:
    """Whatever the status, the break becomes ESCALATED with a MANUAL resolution row."""
    at = as_column(now)
    rows = _commanded(breaks, commands)
    before = F.when(F.col("_first"), F.col("status")).otherwise(F.lit("ESCALATED"))
    return transition(
        rows, at, "ESCALATED", age_seconds("detected_at", at), "escalated", F.col("_actor"),
        F.col("_note"), "MANUAL", before,
    )


def resolve_manually(breaks: DataFrame, commands: DataFrame, now: Column | datetime) -> DataFrame:
    """Whatever the status, the break becomes RESOLVED; its first closing time stays."""
    rows = _commanded(breaks, commands)
    before = F.when(F.col("_first"), F.col("status")).otherwise(F.lit("RESOLVED"))
    return transition(
        rows, as_column(now), "RESOLVED", F.col("age_seconds"), "manually-resolved",
        F.col("_actor"), F.col("_note"), "MANUAL", before,
    )


def open_timing_breaks(
    breaks: DataFrame, source: str, asset: str, reference: str | None = None
) -> DataFrame:
    """Breaks an event with these values could close; any reference if it has none."""
    found = breaks.where(
        (F.col("source") == source)
        & (F.col("asset") == asset)
        & (F.col("classification") == "TIMING")
        & (F.col("status") == "OPEN")
    )
    return found if reference is None else found.where(F.col("reference") == reference)


def count_open_timing_breaks(breaks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per event: how many open timing breaks it could close.

    Breaks are counted per key first; event rows are never multiplied.
    """
    is_open = breaks.where("classification = 'TIMING' AND status = 'OPEN'")
    by_ref = is_open.where("reference IS NOT NULL").groupBy("source", "asset", "reference").agg(
        F.count("*").alias("_with_reference")
    )
    overall = is_open.groupBy("source", "asset").agg(F.count("*").alias("_overall"))
    joined = incoming.join(by_ref, ["source", "asset", "reference"], "left").join(
        overall, ["source", "asset"], "left"
    )
    count = F.when(F.col("reference").isNull(), F.col("_overall")).otherwise(F.col("_with_reference"))
    return joined.select(*incoming.columns, F.coalesce(count, F.lit(0)).alias("open_breaks"))


def first_closing_event(
    breaks: DataFrame, incoming: DataFrame, tolerance_seconds: Column | int
) -> DataFrame:
    """(break_id, ord) of the first event to arrive that closes the break.

    Breaks and events never meet as pairs. For each break the smallest arrival
    position among the events of its key within the tolerance is read from
    running minima over time cells as wide as that interval: it is a tail of
    one cell and a head of the next. A tolerance given as a column stands on
    both sides and is the same for all rows of a source and asset.
    """
    given = F.lit(tolerance_seconds) if isinstance(tolerance_seconds, int) else tolerance_seconds
    tolerance = F.col("tolerance")
    given = (given.cast("bigint") * 1_000_000).alias("tolerance")
    key = ["source", "asset", "amount", "ref"]
    wanted = breaks.where("classification = 'TIMING' AND status = 'OPEN'").select(
        "break_id", "source", "asset",
        amount_or_zero(match_money("internal_amount")).alias("amount"),
        # An event without a reference fits any; one with a reference only its own.
        F.explode(
            F.array_distinct(F.array(F.col("reference"), F.lit(None).cast("string")))
        ).alias("ref"),
        micros("detected_at").alias("t"), given,
    )
    # Breaks of one run share their time, and events may come in bursts: both
    # sides are reduced to distinct key and time, combined before the shuffle.
    moments = wanted.select(*key, "t", "tolerance").distinct()
    offered = (
        incoming.select(
            "source", "asset", amount_or_zero(match_money("amount")).alias("amount"),
            F.col("reference").alias("ref"), micros("ts").alias("t"), "ord", given,
        )
        .groupBy(*key, "t", "tolerance")
        .agg(F.min("ord").alias("ord"))
    )
    parts = F.explode(F.array(F.lit("head"), F.lit("tail"))).alias("part")
    none = F.lit(None).cast("bigint")
    points = offered.where("t IS NOT NULL").select(*key, "t", "ord", none.alias("moment"), parts, "tolerance")
    ends = F.array(
        F.struct((F.col("t") + tolerance).alias("t"), F.lit("head").alias("part")),
        F.struct((F.col("t") - tolerance).alias("t"), F.lit("tail").alias("part")),
    )
    probes = moments.select(*key, F.col("t").alias("moment"), F.explode(ends).alias("p"), "tolerance").select(
        *key, "p.t", none.alias("ord"), "moment", "p.part", "tolerance"
    )
    cell = F.expr("(t - pmod(t, 2 * tolerance + 1)) div (2 * tolerance + 1)")
    # Heads run forward in time, tails backward; an event at the very time of a
    # probe counts, which a range frame takes care of.
    at = F.when(F.col("part") == "head", F.col("t")).otherwise(-F.col("t"))
    running = Window.partitionBy(*key, "part", "cell").orderBy("at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    timed = (
        points.unionByName(probes)
        .withColumn("cell", cell)
        .withColumn("at", at)
        .withColumn("ord", F.min("ord").over(running))
        .where("moment IS NOT NULL AND ord IS NOT NULL")
        .select(*key, F.col("moment").alias("t"), "ord")
    )
    untimed = null_safe_join(moments.drop("tolerance"), offered.where("t IS NULL").select(*key, "ord"), key)
    first = timed.unionByName(untimed.select(*timed.columns)).groupBy(*key, "t").agg(
        F.min("ord").alias("ord")
    )
    found = null_safe_join(wanted, first, [*key, "t"])
    return found.groupBy("break_id").agg(F.min("ord").alias("ord"))


def auto_resolve(
    breaks: DataFrame,
    incoming: DataFrame,
    now: Column | datetime,
    tolerance_seconds: Column | int = schemas.DEFAULT_TOLERANCE_SECONDS,
    enabled: bool = schemas.DEFAULT_AUTO_RESOLVE,
) -> DataFrame:
    """Open timing breaks closed by new events; an event may close many.

    Transitions with `external_event_id`, the event that closed the break.

    Same source, asset and amount; same reference if the event has one; event
    time within the tolerance of the detection, or unknown.
    """
    if not enabled:
        breaks = breaks.limit(0)
    first = first_closing_event(breaks, incoming, tolerance_seconds)
    by = incoming.select("ord", "external_event_id", F.col("reference").alias("_event_ref"))
    closed = breaks.join(first, "break_id").join(by, "ord")
    return transition(
        closed, as_column(now), "RESOLVED", F.lit(0), "auto-resolved", F.lit("system"),
        auto_note(F.col("_event_ref")), "AUTO", keep=("external_event_id",),
    )


def auto_note(reference: Column) -> Column:
    """The note of a break that an event with this reference closed."""
    prefix, _, _ = AUTO_NOTE.partition("{")
    return F.concat(
        F.lit(prefix), F.col("source"), F.lit("/"), F.col("asset"), F.lit("/"),
        F.coalesce(reference, F.lit(MISSING_REFERENCE)),
    )


def set_status(breaks: DataFrame, changes: DataFrame, now: Column | datetime) -> DataFrame:
    """Apply (ord, break_id, new_status, new_age?); a null age leaves the age as it is.

    Of several changes to a break the last by `ord` holds; they are combined
    before the shuffle.
    """
    last = changes.groupBy("break_id").agg(F.max_by(F.struct("new_status", "new_age"), "ord").alias("c"))
    rows = breaks.join(last.select("break_id", "c.*"), "break_id")
    return transition(
        rows, as_column(now), F.col("new_status"), F.coalesce("new_age", "age_seconds"),
        "status", F.lit("system"),
    )


def append_resolutions(breaks: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolution rows whose break exists."""
    return resolutions.join(breaks.select("break_id"), "break_id", "left_semi")


# --- What a set of transitions stands for -----------------------------------


def new_state(transitions: DataFrame) -> DataFrame:
    """One row per changed break."""
    return transitions.select(*_BREAK).dropDuplicates(["break_id"])


def apply_to(breaks: DataFrame, transitions: DataFrame) -> DataFrame:
    """The full state afterwards; transitions are of breaks that exist."""
    changed = new_state(transitions).select("break_id", F.struct(*_BREAK).alias("_new"))
    rows = breaks.select("break_id", F.struct(*_BREAK).alias("_old")).join(changed, "break_id", "left")
    return rows.select(F.coalesce("_new", "_old").alias("b")).select("b.*")


def current_state(breaks: DataFrame, log: DataFrame) -> DataFrame:
    """State after an append-only log of transitions with a `step` column.

    Only the last transition of a break counts; all but one per break and task
    are dropped before the shuffle.
    """
    latest = Window.partitionBy("break_id").orderBy(F.desc("step"), F.desc("at"))
    last = log.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return apply_to(breaks, last)


def resolutions_of(transitions: DataFrame) -> DataFrame:
    return transitions.where("resolution_type IS NOT NULL").select(
        "break_id", F.col("resolution_type").alias("type"), "actor", "note", F.col("at").alias("created_at")
    )


def alerts_of(transitions: DataFrame) -> DataFrame:
    """Escalations alert operators."""
    escalated = transitions.where("action = 'escalated'")
    return events.alerts(escalated, F.col("action"), F.col("actor"), F.col("at"))


def audits_of(transitions: DataFrame) -> DataFrame:
    """One audit row per change of status, with the true values before it."""
    aged = (F.col("action") == "escalated") & F.col("resolution_type").isNull()
    return transitions.where("action NOT IN ('aged', 'status')").select(
        "break_id",
        "action",
        "actor",
        events.state(
            status=F.col("before_status"), age_seconds=F.when(aged, F.col("before_age"))
        ).alias("before"),
        events.state(
            status=F.col("status"), age_seconds=F.when(aged, F.col("age_seconds"))
        ).alias("after"),
        F.col("at").alias("timestamp"),
    )
