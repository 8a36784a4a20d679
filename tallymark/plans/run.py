"""One matching run: choose a strategy, match, detect breaks, count."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import schemas
from tallymark.functions.scalars import stable_id
from tallymark.operators import events
from tallymark.operators.breaks import as_column, detect_breaks
from tallymark.operators.fuzzy import match_fuzzy
from tallymark.operators.matching import MatchOutcome, match_balances, match_exact
from tallymark.operators.rules import strategy_per_source, with_tolerance


def match(
    ledger: DataFrame,
    external: DataFrame,
    strategy: str = schemas.DEFAULT_STRATEGY,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
) -> MatchOutcome:
    """Run the named strategy; an unknown name means EXACT."""
    if strategy == "FUZZY":
        return match_fuzzy(ledger, external, tolerance_seconds)
    if strategy == "BALANCE_ROLLFORWARD":
        return match_balances(ledger, external)
    return match_exact(ledger, external)


def match_batch(
    ledger_rows: DataFrame,
    external_rows: DataFrame,
    strategy: str = schemas.DEFAULT_STRATEGY,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
) -> MatchOutcome:
    """End-of-day matching over loosely typed rows.

    Amounts may come as doubles, columns may be missing; a null ledger amount
    counts as 0 and a missing id or source as ''. Times are kept when given.
    """

    def conform(rows: DataFrame, schema, defaults: dict[str, Column]) -> DataFrame:
        out = []
        for field in schema.fields:
            given = F.col(field.name) if field.name in rows.columns else F.lit(None)
            typed = given.cast(field.dataType)
            if field.name in defaults:
                typed = F.coalesce(typed, defaults[field.name].cast(field.dataType))
            out.append(typed.alias(field.name))
        return rows.select(*out)

    return match(
        conform(ledger_rows, schemas.LEDGER, {"amount": F.lit(0)}),
        conform(
            external_rows,
            schemas.EXTERNAL,
            {"external_event_id": F.lit(""), "source": F.lit("")},
        ),
        strategy,
        tolerance_seconds,
    )


_COUNTERS = ("matched_count", "unmatched_count", "breaks_count")


def count_outcome(outcome: MatchOutcome) -> DataFrame:
    """The three counters of a run as one row.

    Pairs and balanced assets are matched; rows without a partner are
    unmatched; breaks add unbalanced assets and duplicates.
    """
    zero = F.lit(0).cast("bigint")
    one_sided = F.count_if(F.col("l").isNull() != F.col("e").isNull())
    copies = F.count_if(F.col("e.copy") == 2) if outcome.strategy == "EXACT" else zero
    counts = outcome.pairing.agg(
        F.count_if(F.col("l").isNotNull() & F.col("e").isNotNull()).alias("matched_count"),
        one_sided.alias("unmatched_count"),
        (one_sided + copies).alias("breaks_count"),
    )
    if outcome.strategy != "BALANCE_ROLLFORWARD":
        return counts
    balanced = outcome.balances.agg(
        F.count_if("matched").alias("matched_count"),
        zero.alias("unmatched_count"),
        F.count_if(~F.col("matched")).alias("breaks_count"),
    )
    return counts.unionByName(balanced).agg(*[F.sum(c).alias(c) for c in _COUNTERS])


@dataclass(frozen=True)
class Run:
    """A run as plans. Building them reads data only to look for hot keys or,
    for a fuzzy match, to settle it."""

    ledger: DataFrame
    external: DataFrame
    run_id: str
    source: str
    scope: str
    strategy: str
    tolerance_seconds: int
    started_at: datetime
    completed_at: datetime

    @cached_property
    def outcome(self) -> MatchOutcome:
        return match(self.ledger, self.external, self.strategy, self.tolerance_seconds)

    @property
    def breaks(self) -> DataFrame:
        return detect_breaks(
            self.outcome, self.run_id, self.source, self.started_at, self.tolerance_seconds
        )

    @property
    def counters(self) -> DataFrame:
        """Counted from the pairs and breaks of the run."""
        return count_outcome(self.outcome)

    @property
    def record(self) -> DataFrame:
        return self.counters.select(
            F.lit(self.run_id).alias("run_id"),
            F.lit(self.source).alias("source"),
            F.lit(self.scope).alias("scope"),
            F.lit("COMPLETED").alias("status"),
            *_COUNTERS,
            as_column(self.started_at).alias("started_at"),
            as_column(self.completed_at).alias("completed_at"),
        )


def reconcile(
    ledger: DataFrame,
    external: DataFrame,
    *,
    run_id: str,
    source: str,
    scope: str = "daily",
    strategy: str = schemas.DEFAULT_STRATEGY,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
    started_at: datetime,
    completed_at: datetime | None = None,
) -> Run:
    return Run(
        ledger, external, run_id, source, scope, strategy, tolerance_seconds, started_at,
        completed_at or started_at,
    )


def ledger_lookback(
    ledger: DataFrame, started_at: datetime, tolerance_seconds: int
) -> DataFrame:
    """Ledger rows no older than one tolerance before the start of the run."""
    since = as_column(started_at) - F.make_dt_interval(secs=F.lit(tolerance_seconds))
    return ledger.where(F.col("ts") >= since)


def run_id_for(source: str, scope: str, started_at: datetime) -> Column:
    return stable_id(F.lit(source), F.lit(scope), as_column(started_at))


def _attempt(spark: SparkSession, out: str, run_id: str) -> int:
    """How often the run was begun before."""
    try:
        records = spark.read.schema(T.StructType([*schemas.RUN.fields, T.StructField("seq", T.IntegerType())])).parquet(f"{out}/runs")
    except AnalysisException:  # nothing was written yet
        return 0
    return records.where((F.col("run_id") == run_id) & (F.col("status") == "RUNNING")).count()


def _append_run(spark: SparkSession, out: str, status: str, seq: int, **values) -> None:
    row = {"run_id": None, "source": None, "scope": None, "status": status, "matched_count": 0,
           "unmatched_count": 0, "breaks_count": 0, "started_at": None, "completed_at": None, **values}
    frame = spark.createDataFrame([tuple(row[c] for c in schemas.columns(schemas.RUN))], schemas.RUN)
    frame.withColumn("seq", F.lit(seq)).write.mode("append").parquet(f"{out}/runs")


def rule_settings(rules: DataFrame, source: str) -> dict:
    """Strategy and tolerance of a source by its rules."""
    own = rules.where(F.col("source") == source)
    one = own.sparkSession.createDataFrame([(source, None)], "source string, asset string")
    strategy = strategy_per_source(one, own).first().strategy
    tolerance = with_tolerance(one, own.where("asset IS NULL")).first().tolerance_seconds
    return {"strategy": strategy, "tolerance_seconds": int(tolerance)}


def execute(
    ledger: DataFrame,
    external: DataFrame,
    out: str,
    *,
    run_id: str,
    source: str,
    scope: str = "daily",
    strategy: str | None = None,
    tolerance_seconds: int | None = None,
    rules: DataFrame | None = None,
    started_at: datetime,
) -> None:
    """Run and write: pairing, breaks, alerts, audits and run records under `out`.

    The pairing is written once and everything else is read from it. Files are
    replaced per run id, so a repeated run leaves the same state. Each attempt
    adds two run records; the latest one, COMPLETED or FAILED, counts.

    Only events of `source` are taken. With `rules`, the first rule of the
    source gives the strategy, and its rule for all assets the tolerance,
    wherever they are not given.
    """
    spark = ledger.sparkSession
    header = {"run_id": run_id, "source": source, "scope": scope, "started_at": started_at}
    seq = 2 * _attempt(spark, out, run_id)
    _append_run(spark, out, "RUNNING", seq, **header)
    try:
        external = external.where(F.col("source") == source)
        by_rule = rule_settings(rules, source) if rules is not None else {}
        strategy = strategy or by_rule.get("strategy") or schemas.DEFAULT_STRATEGY
        if tolerance_seconds is None:
            tolerance_seconds = by_rule.get("tolerance_seconds", schemas.DEFAULT_TOLERANCE_SECONDS)
        outcome = match(ledger, external, strategy, tolerance_seconds)
        place = f"{out}/pairing/run_id={run_id}"
        outcome.pairing.write.mode("overwrite").parquet(place)
        pairing = spark.read.schema(outcome.pairing.schema).parquet(place)
        stored = replace(outcome, pairing=pairing)
        found = detect_breaks(stored, run_id, source, started_at, tolerance_seconds)
        found.drop("run_id").write.mode("overwrite").parquet(f"{out}/breaks/run_id={run_id}")
        breaks = spark.read.schema(found.schema).parquet(f"{out}/breaks").where(
            F.col("run_id") == run_id
        )
        alerts = events.alerts(breaks, "detected", "system", as_column(started_at))
        audits = events.detected_audits(breaks, as_column(started_at))
        events.as_messages(alerts).write.mode("overwrite").json(f"{out}/alerts/run_id={run_id}")
        events.as_audit_messages(audits).write.mode("overwrite").json(
            f"{out}/audits/run_id={run_id}"
        )
        counts = count_outcome(stored).first()
    except Exception:
        _append_run(spark, out, "FAILED", seq + 1, **header)
        raise
    _append_run(spark, out, "COMPLETED", seq + 1, **header, **counts.asDict(), completed_at=datetime.now(timezone.utc))

