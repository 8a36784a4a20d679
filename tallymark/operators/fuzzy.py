"""Pairing by amount within a time tolerance.

Ledger rows are served in arrival order; each takes the nearest free event with
the same asset and amount. That order matters only between rows that can reach
the same event, so the work is cut where they cannot:

1. Rows are counted per (asset, amount, time cell), combined before the
   shuffle. Neighbouring cells further apart than the tolerance separate
   blocks. Blocks with rows on one side only are done.
2. A block with one row on each side is decided from those counts alone.
   In a block whose rows all carry the same time everybody takes the next free
   event, so it is paired by numbering both sides, whatever its size.
3. Other blocks are settled in tasks, many per task. A block above
   `chunk_rows` is cut into chunks of whole cells (a minute at most), each
   settled on its own with the events it can see beyond its ends. A chunk sees
   further when one of its rows may be served better from there.
4. Chunks of one block tell each other which shared events they took, and
   those that learn something new are settled again, until nothing changes.
   The fixed point is the serial result: by induction over arrival order no
   ledger row can be served differently.

Rows without a time can meet rows at any time. A small key is then settled
whole; for a large one see `operators.timeless`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.ranking import null_safe_join
from tallymark.operators import chunks as ck
from tallymark.operators.matching import (
    ENTRY,
    MatchOutcome,
    as_pairing,
    empty_balances,
    pair_in_order,
)
from tallymark.operators.timeless import pair_large_keys
from tallymark.session import materialise

_PAIR = ["l_ord", "e_ord", "delta_us"]


def _rows_of(rows: DataFrame, cells: DataFrame, route: str) -> DataFrame:
    """Rows of the large keys with this route; there are few such keys."""
    keys = cells.where(F.col("route") == route).select(*ck.KEY).distinct()
    return null_safe_join(rows, keys, ck.KEY)


def _next_free(rows: DataFrame, keys: list[str], hot_rows: int | None) -> DataFrame:
    paired = pair_in_order(rows, keys, hot_rows).where("l IS NOT NULL AND e IS NOT NULL")
    return paired.select(
        F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"),
        F.lit(0).cast("bigint").alias("delta_us"),
    )


def _pair_instants(
    rows: DataFrame, cells: DataFrame, tolerance_us: int, hot_rows: int | None
) -> DataFrame:
    placed = null_safe_join(
        ck.with_cell(rows, tolerance_us), cells.select(*ck.KEY, "cell", "gid"), [*ck.KEY, "cell"]
    )
    return _next_free(placed.select("gid", "side", "ord"), ["gid"], hot_rows)


def pair_fuzzy(
    ledger: DataFrame,
    external: DataFrame,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
    chunk_rows: int = ck.CHUNK_ROWS,
    hot_rows: int | None = None,
) -> DataFrame:
    """(l_ord, e_ord, delta_us) of every pair."""
    tolerance_us = tolerance_seconds * 1_000_000
    rows = ck.narrow_rows(ledger, external)
    cells = materialise(ck.plan_cells(rows, tolerance_us, chunk_rows))
    several_rows = cells.where("(block_l > 1 OR block_e > 1) AND route IN ('timed', 'whole')")
    busy = several_rows.where("NOT instant")
    found = [
        ck.decide_single(cells, tolerance_us),
        ck.settle(ck.whole_blocks(rows, busy.where("chunks = 1"), tolerance_us), tolerance_us),
    ]
    # At most sixteen combinations.
    kinds = cells.select("route", "instant", (F.col("chunks") > 1).alias("cut")).distinct().collect()
    if any(k.instant for k in kinds):
        found.append(_pair_instants(rows, several_rows.where("instant"), tolerance_us, hot_rows))
    if any(k.cut for k in kinds):
        found.append(ck.settle_chunked(rows, busy.where("chunks > 1"), tolerance_us))
    routes = {k.route for k in kinds}
    if "numbered" in routes:
        # One side has no times at all: everybody takes the next free event.
        found.append(_next_free(_rows_of(rows, cells, "numbered"), ck.KEY, hot_rows))
    if "mixed" in routes:
        found.append(pair_large_keys(_rows_of(rows, cells, "mixed"), tolerance_us, chunk_rows))
    return reduce(DataFrame.unionByName, [f.select(*_PAIR) for f in found])


def match_fuzzy(
    ledger: DataFrame,
    external: DataFrame,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
    chunk_rows: int = ck.CHUNK_ROWS,
) -> MatchOutcome:
    pairs = materialise(pair_fuzzy(ledger, external, tolerance_seconds, chunk_rows))
    entry = F.struct(*[F.col(c) for c in ENTRY])
    seconds = (F.col("delta_us") / F.lit(1_000_000)).cast("decimal(20,6)")
    left = ledger.withColumn("external_event_id", F.lit(None).cast("string")).withColumn(
        "source", F.lit(None).cast("string")
    )
    left_rows = left.select(F.col("ord").alias("l_ord"), entry.alias("l"))
    right_rows = external.select(F.col("ord").alias("e_ord"), entry.alias("e"))
    both = pairs.join(left_rows, "l_ord").join(right_rows, "e_ord")
    nothing = F.lit(None).cast("decimal(20,6)").alias("delta_seconds")
    alone_left = left.join(pairs, F.col("ord") == F.col("l_ord"), "left_anti")
    alone_right = external.join(pairs, F.col("ord") == F.col("e_ord"), "left_anti")
    pairing = (
        both.select("l", "e", seconds.alias("delta_seconds"))
        .unionByName(as_pairing(alone_left, "l").select("*", nothing))
        .unionByName(as_pairing(alone_right, "e").select("*", nothing))
    )
    none = external.limit(0).select(*schemas.columns(schemas.EXTERNAL))
    return MatchOutcome("FUZZY", pairing, empty_balances(ledger), none)
