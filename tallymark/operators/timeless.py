"""Fuzzy matching of large keys in which some rows have no time.

A row without a time can meet any row of its key, so cutting by time alone is
not enough. Two observations keep the pieces bounded:

1. While events without a time are left, every ledger row with a time takes
   the next of them, and one without takes the earliest event of any kind.
   How many such events are used up before a ledger row is `used`; it grows by
   one at a row with a time and becomes max(used, c) at a row without, where c
   counts the events without a time among as many earliest events as rows were
   served. Unrolled that is a running count plus a running maximum, and the
   partner follows from the count.
2. Afterwards rows with a time are settled in chunks by time, and rows without
   one take, in arrival order, events that are still free at their turn. The
   latter is a scan over events in slices by arrival. Chunks and slices tell
   each other what they took until nothing changes, as chunks do among
   themselves; the fixed point is the serial result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.nearest import nearest_between, scan_in_order
from tallymark.functions.ranking import before, null_safe_join, number_hot_rows
from tallymark.operators import chunks as ck
from tallymark.operators.chunks import EVENT, KEY, LEDGER, is_short
from tallymark.session import materialise

_FREE = (1 << 62) + (1 << 61)
_NULL_BUCKET_BITS = 14


def pair_large_keys(rows: DataFrame, tolerance_us: int, chunk_rows: int) -> DataFrame:
    """(l_ord, e_ord, delta_us) for the rows of large keys."""
    rows = materialise(rows)
    events = _numbered_events(rows.where(f"side = {EVENT}"))
    served = materialise(_serve_timeless(rows.where(f"side = {LEDGER}"), events))
    first = served.where("e_ord IS NOT NULL")
    early = _with_distance(first, rows, tolerance_us, chunk_rows)
    rest = served.where("e_ord IS NULL").select(*KEY, "ord", "t")
    free = events.where("t IS NOT NULL").join(
        first.select(F.col("e_ord").alias("ord")), "ord", "left_anti"
    )
    late = _settle_rest(rest, materialise(free), tolerance_us, chunk_rows)
    return early.unionByName(late)


def _numbered_events(events: DataFrame) -> DataFrame:
    """Add n (position in the key), m (position among those with or without a
    time) and c (events without a time up to this one)."""
    timeless = F.col("t").isNull()
    rows = number_hot_rows(events.withColumn("timeless", timeless), KEY, "n")
    rows = number_hot_rows(rows, [*KEY, "timeless"], "m")
    count = F.when(F.col("timeless"), F.col("m")).otherwise(F.col("n") - F.col("m"))
    return materialise(rows.withColumn("c", count))


def _serve_timeless(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger rows with the event taken while events without a time last.

    Columns: key, ord, t, e_ord (null for rows served later), mark and low (the
    arrivals between which a free event with a time must lie).
    """
    totals = events.groupBy(*KEY).agg(F.count_if("timeless").alias("total"))
    rows = null_safe_join(number_hot_rows(ledger, KEY, "n"), totals, KEY)
    counts = events.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("n").alias("_n"), "c")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY] + [F.col("n") == F.col("_n")]
    rows = rows.join(counts, on, "left").drop("_n", *[f"_{k}" for k in KEY])
    rows = rows.withColumn("c", F.coalesce("c", "total"))
    has_time = F.col("t").isNotNull()
    rows = before(rows, KEY, has_time.cast("bigint"), "timed", F.sum)
    rows = rows.withColumn("timed", F.coalesce("timed", F.lit(0)))
    lead = F.when(~has_time, F.col("c") - F.col("timed"))
    rows = before(rows, KEY, lead, "lead", F.max)
    used = F.col("timed") + F.greatest(F.lit(0), F.col("lead"))
    rows = rows.withColumn("used", used).withColumn("others", F.col("n") - 1 - used)
    takes_timeless = has_time | (F.col("used") < F.col("c"))
    rows = rows.withColumn("early", F.col("used") < F.col("total"))
    rows = rows.withColumn("want_timeless", F.when(F.col("early"), takes_timeless)).withColumn(
        "want", F.when(takes_timeless, F.col("used")).otherwise(F.col("others")) + 1
    )
    partner = events.select(
        *KEY, F.col("timeless").alias("want_timeless"), F.col("m").alias("want"),
        F.col("ord").alias("e_ord"),
    )
    next_timed = events.where("NOT timeless").select(
        *KEY, (F.col("m") - 1).alias("others"), F.col("ord").alias("low")
    )
    rows = _left_join(rows, partner, [*KEY, "want_timeless", "want"])
    rows = _left_join(rows, next_timed, [*KEY, "others"])
    return rows.select(
        *KEY, "ord", "t", "e_ord", F.col("e_ord").alias("mark"),
        F.coalesce("low", F.lit(_FREE)).alias("low"),
    )


def _left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    # Only key columns may be null on both sides; positions never match a null.
    on = [
        F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k in KEY else F.col(k) == F.col(f"_r_{k}")
        for k in keys
    ]
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def _with_distance(
    first: DataFrame, rows: DataFrame, tolerance_us: int, chunk_rows: int
) -> DataFrame:
    """Pairs made early. A ledger row with a time reports the distance to the
    nearest free event that arrived before the one it took, or 0."""
    zero = F.lit(0).cast("bigint")
    probes = first.where("t IS NOT NULL").select(
        *KEY, F.lit(LEDGER).alias("side"), "ord", "t", "mark", "low"
    )
    timed = rows.where(f"side = {EVENT} AND t IS NOT NULL").select(
        *KEY, "side", "ord", "t", zero.alias("mark"), zero.alias("low")
    )
    around = materialise(probes.unionByName(timed))
    cells = materialise(ck.plan_cells(around, tolerance_us, chunk_rows))
    chunks = ck.Chunks(around, cells, tolerance_us)

    def work(u: dict[str, np.ndarray]):
        left, event = u["kind"] == LEDGER, u["kind"] == EVENT
        l_ord, distance = nearest_between(
            u["ord"][left], u["t"][left], u["low"][left], u["mark"][left],
            u["ord"][event], u["t"][event], tolerance_us,
        )
        short = is_short(u, left, l_ord, distance, tolerance_us)
        return {"l_ord": l_ord, "near_us": distance}, short

    near = materialise(ck.per_unit(chunks.units(), work, "near_us"))
    while True:
        short = materialise(near.where("near_us < 0").select("gid", "chunk"))
        if short.isEmpty():
            break
        chunks.widen(short)
        units = chunks.units().join(short, ["gid", "chunk"], "left_semi")
        kept = near.join(short, ["gid", "chunk"], "left_anti")
        near = materialise(kept.unionByName(ck.per_unit(units, work, "near_us")))
    near = near.select("l_ord", "near_us")
    return first.select(F.col("ord").alias("l_ord"), "e_ord").join(near, "l_ord", "left").select(
        "l_ord", "e_ord", F.coalesce("near_us", F.lit(0)).alias("delta_us")
    )


def _settle_rest(
    rest: DataFrame, free: DataFrame, tolerance_us: int, chunk_rows: int
) -> DataFrame:
    """Everything that is left once no event without a time is."""
    timed_rows = rest.where("t IS NOT NULL").select(
        *KEY, F.lit(LEDGER).alias("side"), "ord", "t"
    ).unionByName(free.select(*KEY, "side", "ord", "t"))
    timed_rows = materialise(timed_rows)
    cells = materialise(ck.plan_cells(timed_rows, tolerance_us, chunk_rows))
    rounds = ck.Rounds(ck.Chunks(timed_rows, cells, tolerance_us))
    lanes = free.groupBy(*KEY).agg(F.min("ord").alias("lane"))
    slots = null_safe_join(free, lanes, KEY).select(
        "lane", F.expr(f"CAST((m - 1) div {chunk_rows} AS INT)").alias("slice"), "ord"
    )
    slots = materialise(slots)
    waiting = null_safe_join(rest.where("t IS NULL"), lanes, KEY)
    waiting = number_hot_rows(waiting.select("lane", "ord"), ["lane"], "n").select(
        "lane", "ord", (F.col("n") - 1).alias("place")
    )
    waiting = materialise(waiting)

    starts = materialise(_starts(_unclaimed(slots, rounds.pairs)))
    while True:
        scanned = materialise(_scan(slots, waiting, rounds.pairs, starts))
        next_starts = materialise(_starts(_taken_per_slice(slots, scanned)))
        moved = not next_starts.join(starts, ["lane", "slice", "start"], "left_anti").isEmpty()
        # Every event a chunk sees may be taken by a row without a time.
        changed = rounds.again(scanned.select("l_ord", "e_ord"))
        if not changed and not moved:
            result = ["l_ord", "e_ord", "delta_us"]
            return rounds.pairs.select(*result).unionByName(scanned.select(*result))
        starts = next_starts


def _unclaimed(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """First guess: a scan takes whatever no row with a time wants."""
    free = slots.join(pairs.select(F.col("e_ord").alias("ord")), "ord", "left_anti")
    return _with_all_slices(slots, free.groupBy("lane", "slice").agg(F.count("*").alias("took")))


def _taken_per_slice(slots: DataFrame, scanned: DataFrame) -> DataFrame:
    took = scanned.groupBy(F.col("gid").alias("lane"), F.col("chunk").alias("slice")).agg(
        F.count("*").alias("took")
    )
    return _with_all_slices(slots, took)


def _with_all_slices(slots: DataFrame, took: DataFrame) -> DataFrame:
    every = slots.groupBy("lane", "slice").agg(F.count("*").alias("_size"))
    return every.join(took, ["lane", "slice"], "left").select(
        "lane", "slice", F.coalesce("took", F.lit(0)).alias("took")
    )


def _starts(took: DataFrame) -> DataFrame:
    """Rows without a time served before each slice. A lane has one row per slice here."""
    earlier = Window.partitionBy("lane").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return took.select(
        "lane", "slice", F.coalesce(F.sum("took").over(earlier), F.lit(0)).alias("start")
    )


def _scan(slots: DataFrame, waiting: DataFrame, pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Scan every slice from its start.

    A slice gets the events still there when its first row comes, and as many
    waiting rows as it has such events.
    """
    gone = pairs.select(F.col("e_ord").alias("ord"), F.col("l_ord").alias("gone_at"))
    first = starts.join(
        waiting.select("lane", F.col("place").alias("start"), F.col("ord").alias("first_row")),
        ["lane", "start"],
    )
    offered = (
        slots.join(gone, "ord", "left")
        .withColumn("gone_at", F.coalesce("gone_at", F.lit(_FREE)))
        .join(first, ["lane", "slice"])
        .where("gone_at > first_row")
    )
    room = offered.groupBy("lane", "slice", "start").agg(F.count("*").alias("room"))
    bucket = F.shiftright("place", _NULL_BUCKET_BITS)
    reach = F.sequence(
        F.shiftright("start", _NULL_BUCKET_BITS),
        F.shiftright(F.col("start") + F.col("room") - 1, _NULL_BUCKET_BITS),
    )
    served = (
        room.withColumn("bucket", F.explode(reach))
        .join(waiting.withColumn("bucket", bucket), ["lane", "bucket"])
        .where("place >= start AND place < start + room")
    )

    def as_unit(frame: DataFrame, kind: int) -> DataFrame:
        return ck.as_units(
            frame.withColumnRenamed("lane", "gid").withColumnRenamed("slice", "chunk").withColumn(
                "kind", F.lit(kind)
            )
        )

    def work(u: dict[str, np.ndarray]):
        left, event = u["kind"] == LEDGER, u["kind"] == EVENT
        l_ord, e_ord = scan_in_order(u["ord"][left], u["ord"][event], u["t"][event])
        return {"l_ord": l_ord, "e_ord": e_ord}, False

    events = as_unit(offered.withColumnRenamed("gone_at", "t"), EVENT)
    return ck.per_unit(as_unit(served, LEDGER).unionByName(events), work, "delta_us")
