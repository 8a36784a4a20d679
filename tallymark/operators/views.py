"""Listings and look-ups over the stored state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators.breaks import as_column


def filter_breaks(
    breaks: DataFrame,
    source: str | None = None,
    status: str | None = None,
    classification: str | None = None,
    asset: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """All given conditions hold; both ends of the time range are included."""
    wanted = {"source": source, "status": status, "classification": classification, "asset": asset}
    for column, value in wanted.items():
        if value is not None:
            breaks = breaks.where(F.col(column) == value)
    if since is not None:
        breaks = breaks.where(F.col("detected_at") >= as_column(since))
    if until is not None:
        breaks = breaks.where(F.col("detected_at") <= as_column(until))
    return breaks


def list_breaks(
    breaks: DataFrame, limit: int | None = schemas.DEFAULT_LIST_LIMIT, **conditions
) -> DataFrame:
    """Newest first; a listing has a length, jobs over breaks do not."""
    found = filter_breaks(breaks, **conditions).orderBy(F.desc("detected_at"), "break_id")
    return found if limit is None else found.limit(limit)


def get_break(breaks: DataFrame, break_id: str) -> DataFrame:
    return breaks.where(F.col("break_id") == break_id)


def break_history(breaks: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Each break with its resolutions as rows; breaks without any have one row.

    Kept flat, because nothing limits how often a break is acted on. The inner
    join can be split on either side where one break has very many.
    """
    steps = resolutions.select(
        "break_id",
        F.col("type").alias("resolution_type"),
        "actor",
        "note",
        F.col("created_at").alias("resolution_at"),
    )
    acted_on = breaks.join(steps, "break_id")
    untouched = breaks.join(steps.select("break_id").distinct(), "break_id", "left_anti")
    blank = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in steps.columns[1:]]
    return acted_on.unionByName(untouched.select("*", *blank))


def break_with_history(breaks: DataFrame, resolutions: DataFrame, break_id: str) -> DataFrame:
    """One break with its resolutions, oldest first."""
    own = resolutions.where(F.col("break_id") == break_id)
    return break_history(get_break(breaks, break_id), own).orderBy("resolution_at")


def list_runs(runs: DataFrame, source: str | None = None) -> DataFrame:
    found = runs if source is None else runs.where(F.col("source") == source)
    return found.orderBy(F.desc("started_at"), "run_id")


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def latest_runs(run_records: DataFrame) -> DataFrame:
    """Run records are appended (RUNNING, then the end); the last one counts."""
    values = [c for c in schemas.columns(schemas.RUN) if c != "run_id"]
    last = run_records.groupBy("run_id").agg(F.max_by(F.struct(*values), "seq").alias("r"))
    return last.select("run_id", "r.*")
