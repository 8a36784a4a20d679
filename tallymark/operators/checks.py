"""Checks over detected breaks and leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.scalars import micros
from tallymark.operators.matching import MatchOutcome, pair_in_order
from tallymark.session import materialise

_NATURAL_KEY = ["type", "source", "asset", "reference", "internal_amount", "external_amount"]


def new_breaks_only(found: DataFrame, breaks: DataFrame) -> DataFrame:
    """Breaks of this run that are not open already; null equals null."""
    open_breaks = breaks.where("status = 'OPEN'")
    # Equal rows are combined before the shuffle, however often a break recurs.
    known = open_breaks.select(*[F.col(c).alias(f"k_{c}") for c in _NATURAL_KEY]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _NATURAL_KEY]
    return found.join(known, on, "left_anti")


def amount_mismatches(outcome: MatchOutcome, hot_rows: int | None = None) -> DataFrame:
    """Leftovers with the same reference and asset but another amount.

    Paired in arrival order within the key, so copies of one reference do not
    multiply.
    """
    alone = outcome.pairing.where("(l IS NULL) <> (e IS NULL)")
    side = F.when(F.col("l").isNotNull(), 0).otherwise(1).alias("side")
    rows = alone.select(side, F.coalesce("l", "e").alias("x")).select("side", "x.*")
    # Read several times below; written once, without the work that found it.
    rows = materialise(rows.where("reference IS NOT NULL"))
    paired = pair_in_order(rows, ["reference", "asset"], hot_rows)
    both = paired.where("l IS NOT NULL AND e IS NOT NULL").where(
        "l.amount <> coalesce(e.amount, 0)"
    )
    external_amount = F.coalesce(F.col("e.amount"), F.lit(0).cast(schemas.MATCH_MONEY))
    return both.select(
        "reference",
        "asset",
        F.col("l.ord").alias("l_ord"),
        F.col("e.ord").alias("e_ord"),
        F.col("l.amount").alias("internal_amount"),
        external_amount.alias("external_amount"),
        (external_amount - F.col("l.amount")).cast(schemas.MATCH_MONEY).alias("difference"),
    )


def detection_latency(
    rows: DataFrame, event_time: Column, detected_at: Column, limit_seconds: int = 300
) -> DataFrame:
    """Per source: how long after the event breaks are detected.

    Counts per range add up across partial results; the quantile is approximate.
    """
    late = (micros(detected_at) - micros(event_time)) / F.lit(1_000_000)
    timed = rows.withColumn("_s", late).where("_s IS NOT NULL")
    return timed.groupBy("source").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("_s") <= 60).alias("within_1_min"),
        F.count_if(F.col("_s") <= limit_seconds).alias("within_limit"),
        F.count_if(F.col("_s") > limit_seconds).alias("over_limit"),
        F.max("_s").alias("max_seconds"),
        F.percentile_approx("_s", 0.95, 10_000).alias("p95_seconds"),
    )
