"""Numbering rows inside a key when one key may hold a large share of all rows.

A plain `row_number()` sends a whole key to one task. Here keys that may be
hot are found first, and only their rows take a longer way: each is numbered
inside a slice of at most 2^20 arrival positions, and the row counts of the
earlier slices of the key are added. Slices are cut on `ord`, which is a BIGINT
unique on its side, so the limit holds for any data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialise

# Keys are counted by hash bucket, so the list of hot buckets has at most this
# many rows and can always be broadcast.
HASH_BUCKETS = 16_384
HOT_ROWS = 1_000_000
SLICE_BITS = 20

_BUCKET = "_hash_bucket"


def key_bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Hash buckets with more than `hot_rows` rows, however many rows there are; at most HASH_BUCKETS.

    Counting is combined before the shuffle, so each task sends at most one row
    per bucket. A hot bucket may also hold ordinary keys: the longer way is
    right for any key, so this only costs them a little time.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    counts = rows.groupBy(key_bucket(keys).alias(_BUCKET)).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > limit).select(_BUCKET)


def split_by_heat(
    rows: DataFrame, keys: list[str], hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of possibly hot keys or None).

    Looks at the data when called: one pass over the key columns. Data without
    hot keys, the usual case, then needs no second plan.
    """
    hot = hot_buckets(rows, keys, hot_rows)
    if hot.isEmpty():
        return rows, None
    hot = F.broadcast(materialise(hot))
    tagged = rows.withColumn(_BUCKET, key_bucket(keys))
    return (
        tagged.join(hot, _BUCKET, "left_anti").drop(_BUCKET),
        tagged.join(hot, _BUCKET, "left_semi").drop(_BUCKET),
    )


def before(
    rows: DataFrame, keys: list[str], value: Column, out: str, combine: Callable = F.sum
) -> DataFrame:
    """`combine` (F.sum or F.max) of `value` over the rows of the key that come
    earlier by ord; null if there are none. No task is bound to a whole key.
    """
    sliced = (
        rows.withColumn("_value", value)
        .withColumn("_slice", F.shiftright("ord", SLICE_BITS))
        .withColumn("_group", F.shiftright("ord", 2 * SLICE_BITS))
    )

    def earlier(part: list[str], order: str) -> Column:
        frame = Window.partitionBy(*part).orderBy(order)
        return combine("_value").over(frame.rowsBetween(Window.unboundedPreceding, -1))

    def joined(*parts: str) -> Column:
        if combine is F.sum:
            known = F.coalesce(*parts)
            total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
            return F.when(known.isNotNull(), total)
        return F.greatest(*parts)

    # What comes before a slice = earlier groups of slices
    # + earlier slices of the same group.
    slices = sliced.groupBy(*keys, "_group", "_slice").agg(combine("_value").alias("_value"))
    groups = slices.groupBy(*keys, "_group").agg(combine("_value").alias("_value"))
    starts = groups.select(*keys, "_group", earlier(keys, "_group").alias("_of_group"))
    offsets = null_safe_join(
        slices.withColumn("_of_slice", earlier([*keys, "_group"], "_slice")), starts, [*keys, "_group"]
    ).select(*keys, "_slice", "_of_group", "_of_slice")
    local = sliced.withColumn("_local", earlier([*keys, "_slice"], "ord"))
    return (
        null_safe_join(local, offsets, [*keys, "_slice"])
        .withColumn(out, joined("_of_group", "_of_slice", "_local"))
        .drop("_value", "_slice", "_group", "_local", "_of_group", "_of_slice")
    )


def number_hot_rows(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`row_number()` over (keys ordered by ord) with no task bound to a whole key."""
    one = F.lit(1).cast("bigint")
    counted = before(rows, keys, one, out, F.sum)
    return counted.withColumn(out, (F.coalesce(F.col(out), F.lit(0)) + 1).cast("bigint"))


def number_rows(
    rows: DataFrame, keys: list[str], out: str, hot_rows: int | None = None
) -> DataFrame:
    """Position of each row inside its key by `ord`, for keys of any size."""
    usual, hot = split_by_heat(rows, keys, hot_rows)
    by_key = Window.partitionBy(*keys).orderBy("ord")
    usual = usual.withColumn(out, F.row_number().over(by_key).cast("bigint"))
    if hot is None:
        return usual
    return usual.unionByName(number_hot_rows(hot, keys, out))


SALTS = 256


def first_rows(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first `count` rows of each key by ord.

    Picked among the rows of each salt first, so a large key is sorted by many
    tasks and at most SALTS x count of its rows meet.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
    for part in ([*keys, "_salt"], keys):
        first = Window.partitionBy(*part).orderBy("ord")
        salted = salted.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= count)
    return salted.drop("_salt", "_n")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equality join where null equals null; keys appear once."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, "inner").drop(*[f"_r_{k}" for k in keys])
