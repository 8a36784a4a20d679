"""Quantiles of detection latency from histograms that merge by adding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to each power of two, as a power of two: 2^5 make a bucket at most 1/32 of its values wide.
BITS = 5


def bucket(value: Column) -> Column:
    """The bucket of a whole number of at least 0: exact below 2^(BITS + 1)."""
    shift = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return (F.shiftleft(shift.cast("bigint"), BITS) + F.call_function("shiftright", value, shift)).cast("bigint")


def edges(of: Column) -> tuple[Column, Column]:
    """The least and the largest number of a bucket."""
    shift = F.greatest(F.floor(of / (1 << BITS)) - 1, F.lit(0)).cast("int")
    head = of - F.shiftleft(shift.cast("bigint"), BITS)
    return F.call_function("shiftleft", head, shift), F.call_function("shiftleft", head + 1, shift) - 1


def latency_sketch(rows: DataFrame, value: Column, *keys: Column | str) -> DataFrame:
    """(keys, bucket, n) of `value`, a whole number; negative ones count as 0, null ones not. Stored per day, it is all that later questions need."""
    at = bucket(F.greatest(value, F.lit(0).cast("bigint")))
    return rows.where(value.isNotNull()).groupBy(*keys, at.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketch of coarser keys: a day's add up to a month's, sources to the whole."""
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, share: float, *keys: str) -> DataFrame:
    """Per keys: count, and for the quantile at `share` its bounds `low` and `high` with the ranks that lie there.

    The value of rank ceil(share * n) is between `low` and `high`, which are at most
    1/32 apart; ranks `rank_low` to `rank_high` share the bucket, and no other rank does.
    """
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("events", F.sum("n").over(whole))
    rank = F.greatest(F.ceil(F.lit(share).cast("decimal(10,6)") * F.col("events")), F.lit(1))
    here = ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    low, high = edges(F.col("bucket"))
    return here.select(*keys, "events", low.alias("low"), high.alias("high"), (F.col("upto") - F.col("n") + 1).alias("rank_low"), F.col("upto").alias("rank_high"))
