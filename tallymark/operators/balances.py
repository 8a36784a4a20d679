"""Reconciling balances that sources report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.ranking import before
from tallymark.functions.scalars import micros
from tallymark.operators.breaks import as_column

_KEY = ["source", "asset"]


def _last_balance(snapshots: DataFrame, name: str) -> DataFrame:
    """The latest snapshot per key; the later arrival if two carry one time."""
    return snapshots.groupBy(*_KEY).agg(
        F.max_by("balance", F.struct("ts", "ord")).alias(name), F.max("ts").alias(f"{name}_at")
    )


def roll_forward_window(
    flows: DataFrame, snapshots: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Opening balance + flows in (start, end] against the closing balance.

    Per source and asset, whichever of the three parts exists.
    """
    low, high = as_column(start), as_column(end)
    opening = _last_balance(snapshots.where(F.col("ts") <= low), "opening")
    closing = _last_balance(snapshots.where(F.col("ts") <= high), "closing")
    moved = (
        flows.where((F.col("ts") > low) & (F.col("ts") <= high))
        .groupBy(*_KEY)
        .agg(F.sum("amount").alias("net_flow"))
    )
    money = schemas.MATCH_MONEY
    zero = F.lit(0).cast(money)
    joined = (
        opening.select(*_KEY, "opening")
        .join(closing.select(*_KEY, "closing"), _KEY, "full_outer")
        .join(moved, _KEY, "full_outer")
        .select(
            *_KEY,
            F.coalesce("opening", zero).alias("opening"),
            F.coalesce("net_flow", zero).alias("net_flow"),
            F.coalesce("closing", zero).alias("actual_closing"),
        )
        .withColumn("expected_closing", (F.col("opening") + F.col("net_flow")).cast(money))
    )
    return joined.withColumn(
        "delta", (F.col("actual_closing") - F.col("expected_closing")).cast(money)
    ).withColumn("matched", F.col("delta") == 0)


def check_snapshots(flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The latest reported balance per key against the ledger total up to its time."""
    latest = _last_balance(snapshots, "reported")
    totals = (
        flows.join(latest.select(*_KEY, "reported_at"), _KEY)
        .where(F.col("ts") <= F.col("reported_at"))
        .groupBy(*_KEY)
        .agg(F.sum("amount").alias("ledger_total"))
    )
    money = schemas.MATCH_MONEY
    joined = latest.join(totals, _KEY, "left").withColumn(
        "ledger_total", F.coalesce("ledger_total", F.lit(0).cast(money))
    )
    delta = (F.col("reported") - F.col("ledger_total")).cast(money)
    return joined.select(
        *_KEY, "reported", "reported_at", "ledger_total", delta.alias("delta"),
        (delta == 0).alias("matched"),
    )


def all_windows(flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every two consecutive snapshots of a source and asset: opening + flows in between against closing.

    Flows and snapshots are merged by time; a snapshot carries the total of all
    flows up to its time, flows of that very time included, and takes the last
    snapshot before it as its opening. Both are prefixes that are cut into
    slices, so that a key of any size is spread. Of snapshots with one time the
    later arrival counts; rows without a time take no part.
    """
    money = schemas.MATCH_MONEY
    zero = F.lit(0).cast(money)
    reported = snapshots.where("ts IS NOT NULL").groupBy(*_KEY, "ts").agg(F.max_by("balance", "ord").alias("balance"))
    none = F.lit(None).cast(money)
    # Twice the time, and one more for snapshots: they come behind all flows of their time.
    merged = flows.where("ts IS NOT NULL").select(
        *_KEY, (micros("ts") * 2).alias("ord"), F.col("amount").cast(money).alias("amount"), none.alias("balance"), F.lit(False).alias("is_snapshot"),
    ).unionByName(reported.select(
        *_KEY, (micros("ts") * 2 + 1).alias("ord"), none.alias("amount"), F.col("balance").cast(money).alias("balance"), F.lit(True).alias("is_snapshot")))
    totals = before(merged, _KEY, F.col("amount"), "upto").where("is_snapshot").select(
        *_KEY, "ord", "balance", F.coalesce(F.col("upto").cast(money), zero).alias("upto"))
    last = before(totals, _KEY, F.struct("ord", "balance", "upto"), "last", F.max).where("last IS NOT NULL")
    net = (F.col("upto") - F.col("last.upto")).cast(money)
    expected = (F.coalesce("last.balance", zero) + net).cast(money)
    delta = (F.coalesce("balance", zero) - expected).cast(money)
    return last.select(
        *_KEY, F.timestamp_micros(F.expr("(last.ord - 1) div 2")).alias("opened_at"), F.timestamp_micros(F.expr("(ord - 1) div 2")).alias("closed_at"),
        F.coalesce("last.balance", zero).alias("opening"), net.alias("net_flow"), F.coalesce("balance", zero).alias("actual_closing"),
        expected.alias("expected_closing"), delta.alias("delta"), (delta == 0).alias("matched"))
