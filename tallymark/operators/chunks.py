"""Cutting fuzzy matching into bounded pieces and settling them.

See `operators.fuzzy` for the whole method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import tallymark.functions
import tallymark.operators
from tallymark.functions.nearest import UNKNOWN, serve
from tallymark.functions.ranking import null_safe_join
from tallymark.functions.scalars import amount_or_zero, micros
from tallymark.session import materialise

# Code that runs in tasks travels with them; the package need not be installed
# on the executors.
cloudpickle.register_pickle_by_value(tallymark.functions)
cloudpickle.register_pickle_by_value(tallymark.operators)

CHUNK_ROWS = 50_000
_SECOND = 1_000_000
KEY = ["asset", "amount"]
LEDGER, EVENT, CLAIM = 0, 1, 2


def narrow_rows(ledger: DataFrame, external: DataFrame) -> DataFrame:
    left = ledger.where("amount IS NOT NULL").select(
        "asset", "amount", F.lit(LEDGER).alias("side"), "ord", micros("ts").alias("t")
    )
    right = external.select(
        "asset",
        amount_or_zero("amount").alias("amount"),
        F.lit(EVENT).alias("side"),
        "ord",
        micros("ts").alias("t"),
    )
    return left.unionByName(right)


def cell_width(tolerance_us: int) -> int:
    """Ten seconds to a minute: the smallest piece a chunk can be."""
    return min(max(tolerance_us // 8, 10 * _SECOND), 60 * _SECOND)


def with_cell(rows: DataFrame, tolerance_us: int) -> DataFrame:
    return rows.withColumn("cell", F.expr(f"t div {cell_width(tolerance_us)}"))


def plan_cells(rows: DataFrame, tolerance_us: int, chunk_rows: int) -> DataFrame:
    """One row per (asset, amount, cell) that can take part in a pair, with its
    block, chunk and route.

    A key has as many cells as the time span holds, however many rows it has.
    """
    is_ledger, is_event = F.col("side") == LEDGER, F.col("side") == EVENT
    cells = with_cell(rows, tolerance_us).groupBy(*KEY, "cell").agg(
        F.count_if(is_ledger).alias("n_l"),
        F.count_if(is_event).alias("n_e"),
        F.min("t").alias("from_t"),
        F.max("t").alias("to_t"),
        F.min(F.when(is_event, F.col("ord"))).alias("e_ord"),
        F.min(F.when(is_ledger, F.col("ord"))).alias("l_ord"),
        F.min(F.when(is_event, F.col("t"))).alias("e_t"),
        F.min(F.when(is_ledger, F.col("t"))).alias("l_t"),
    )
    key = Window.partitionBy(*KEY)
    timed = F.col("cell").isNotNull()

    def in_key(count: str, when=None):
        value = F.col(count) if when is None else F.when(when, F.col(count)).otherwise(0)
        return F.sum(value).over(key)

    cells = (
        cells.withColumn("key_l", in_key("n_l"))
        .withColumn("key_e", in_key("n_e"))
        .withColumn("timed_l", in_key("n_l", timed))
        .withColumn("timed_e", in_key("n_e", timed))
        .where("key_l > 0 AND key_e > 0")
    )
    # timed: nothing unknown · whole: small enough for one group · numbered: one
    # side has no times at all · mixed: large and both kinds of rows.
    route = (
        F.when(F.expr("key_l = timed_l AND key_e = timed_e"), "timed")
        .when(F.expr(f"key_l + key_e <= {chunk_rows}"), "whole")
        .when(F.expr("timed_l = 0 OR timed_e = 0"), "numbered")
        .otherwise("mixed")
    )
    by_time = key.orderBy("cell")
    gap = F.col("from_t") - F.lag("to_t").over(by_time)
    cells = (
        cells.withColumn("route", route)
        .withColumn("_cut", F.when(gap > tolerance_us, 1).otherwise(0))
        .withColumn("block", F.when(F.col("route") == "timed", F.sum("_cut").over(by_time)).otherwise(-1))
    )
    block = Window.partitionBy(*KEY, "block")
    in_block = block.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("block_l", F.sum("n_l").over(block))
        .withColumn("block_e", F.sum("n_e").over(block))
        .where("block_l > 0 AND block_e > 0")
        # Arrival positions are unique, so the first event names the block.
        .withColumn("gid", F.min("e_ord").over(block))
        .withColumn("_before", F.coalesce(F.sum(F.col("n_l") + F.col("n_e")).over(in_block), F.lit(0)))
        .withColumn(
            "_part",
            F.when(F.col("route") == "timed", F.expr(f"_before div {chunk_rows}")).otherwise(0),
        )
    )
    chunk = Window.partitionBy(*KEY, "block", "chunk")
    return (
        cells.withColumn("chunk", F.dense_rank().over(block.orderBy("_part")).cast("int"))
        .withColumn("chunks", F.max("chunk").over(block))
        .withColumn("chunk_from", F.min("from_t").over(chunk))
        .withColumn("chunk_to", F.max("to_t").over(chunk))
        # All rows of the block carry one and the same time.
        .withColumn(
            "instant",
            (F.col("route") == "timed")
            & (F.min("from_t").over(block) == F.max("to_t").over(block)),
        )
        .select(
            *KEY, "cell", "route", "gid", "chunk", "chunks", "chunk_from", "chunk_to", "instant",
            "block_l", "block_e", "l_ord", "e_ord", "l_t", "e_t",
        )
    )


def decide_single(cells: DataFrame, tolerance_us: int) -> DataFrame:
    """Blocks with one row on each side."""
    best = cells.where("block_l = 1 AND block_e = 1 AND route IN ('timed', 'whole')")
    best = best.groupBy("gid").agg(*[F.max(c).alias(c) for c in ("l_ord", "e_ord", "l_t", "e_t")])
    delta = F.abs(F.col("l_t") - F.col("e_t"))
    return best.where((delta <= tolerance_us) | delta.isNull()).select(
        "l_ord", "e_ord", F.coalesce(delta, F.lit(0)).alias("delta_us")
    )


_UNIT = ["gid", "chunk"]
# mark and low: what claims and probes carry · seen_from and seen_to: the times
# between which the unit of a ledger row has every event.
_UNIT_COLUMNS = ["gid", "chunk", "kind", "ord", "t", "mark", "low", "seen_from", "seen_to"]


def as_units(rows: DataFrame) -> DataFrame:
    """Fill in the unit columns that `rows` does not have."""
    return rows.select(
        *[
            F.col(c) if c in rows.columns else F.lit(0).cast("bigint").alias(c)
            for c in _UNIT_COLUMNS
        ]
    )


def _place(rows: DataFrame, cells: DataFrame, tolerance_us: int) -> DataFrame:
    """Rows with the block and chunk of their cell."""
    placed = null_safe_join(
        with_cell(rows, tolerance_us), cells.select(*KEY, "cell", "gid", "chunk"), [*KEY, "cell"]
    )
    return placed.withColumnRenamed("side", "kind").drop(*KEY)


def whole_blocks(rows: DataFrame, cells: DataFrame, tolerance_us: int) -> DataFrame:
    """Units of blocks that are settled in one piece."""
    placed = _place(rows, cells, tolerance_us)
    return as_units(placed.withColumn("t", F.coalesce("t", F.lit(UNKNOWN))))


class Chunks:
    """Blocks cut into chunks, with the events each chunk sees.

    A chunk sees its own events and those within its reach beyond both ends.
    The reach starts at its own width, so that it sees about three times its
    rows, and grows only for chunks with a ledger row that could be served
    better by an event further away; never beyond the tolerance.
    """

    def __init__(self, rows: DataFrame, cells: DataFrame, tolerance_us: int):
        self.tolerance_us = tolerance_us
        self.width = cell_width(tolerance_us)
        placed = materialise(_place(rows, cells, tolerance_us))
        self.ledger = placed.where(f"kind = {LEDGER}")
        self.events = placed.where(f"kind = {EVENT}")
        own_width = F.col("chunk_to") - F.col("chunk_from")
        reach = F.least(F.lit(tolerance_us), F.greatest(own_width, F.lit(self.width)))
        bounds = cells.select("gid", "chunk", "chunk_from", "chunk_to").distinct()
        self.bounds = materialise(bounds.withColumn("reach", reach.cast("bigint")))
        own = self.events.select("gid", "chunk", "ord", "t")
        self.seen = materialise(own.unionByName(self._beyond(self.bounds)))

    def _beyond(self, bounds: DataFrame) -> DataFrame:
        """Events of other chunks within reach."""

        def cells_between(low, high):
            return F.sequence(F.expr(f"({low}) div {self.width}"), F.expr(f"({high}) div {self.width}"))

        outside = F.concat(
            cells_between("chunk_from - reach", "chunk_from"),
            cells_between("chunk_to", "chunk_to + reach"),
        )
        around = bounds.select("*", F.explode(F.array_distinct(outside)).alias("cell"))
        others = self.events.select("gid", F.col("chunk").alias("_own"), "cell", "ord", "t")
        return (
            around.join(others, ["gid", "cell"])
            .where("_own <> chunk AND t >= chunk_from - reach AND t <= chunk_to + reach")
            .select("gid", "chunk", "ord", "t")
        )

    def widen(self, short: DataFrame) -> None:
        """Let the chunks in `short` see further."""
        further = F.least(F.lit(self.tolerance_us), F.col("reach") * 4).cast("bigint")
        wider = materialise(
            self.bounds.join(short, _UNIT, "left_semi").withColumn("reach", further)
        )
        own = self.events.join(short, _UNIT, "left_semi").select("gid", "chunk", "ord", "t")
        kept = self.seen.join(short, _UNIT, "left_anti")
        self.seen = materialise(kept.unionByName(own).unionByName(self._beyond(wider)))
        self.bounds = materialise(
            self.bounds.join(short, _UNIT, "left_anti").unionByName(wider.select(*self.bounds.columns))
        )

    def units(self) -> DataFrame:
        edges = self.bounds.select(
            "gid", "chunk", (F.col("chunk_from") - F.col("reach")).alias("seen_from"),
            (F.col("chunk_to") + F.col("reach")).alias("seen_to"),
        )
        left = as_units(self.ledger.join(edges, _UNIT))
        return left.unionByName(as_units(self.seen.withColumn("kind", F.lit(EVENT))))

    def settle(self, only: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
        units = self.units()
        if claims is not None:
            units = units.unionByName(claims)
        if only is not None:
            units = units.join(only, _UNIT, "left_semi")
        return settle(units, self.tolerance_us, chunked=True)

    def claims(self, *taken: DataFrame) -> DataFrame:
        """What others took of the events a chunk sees, from (l_ord, e_ord) rows
        with the chunk that took it, if any."""
        seen = self.seen.select("gid", F.col("chunk").alias("seen_by"), F.col("ord").alias("e_ord"))
        found = []
        for pairs in taken:
            by_chunk = "chunk" in pairs.columns
            met = pairs.join(seen, ["gid", "e_ord"] if by_chunk else "e_ord")
            met = met.where("seen_by <> chunk") if by_chunk else met
            found.append(met.select("gid", "seen_by", "e_ord", "l_ord"))
        return materialise(_as_claims(reduce(DataFrame.unionByName, found)))


def by_unit(settle_unit: Callable[[pd.DataFrame], pd.DataFrame]):
    """Feed whole groups, which start where n = 1, to `settle_unit`, holding no
    more than one group and one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            starts = np.nonzero(batch["n"].to_numpy() == 1)[0]
            if not len(starts):
                rest.append(batch)
                continue
            cut = int(starts[-1])
            ready = pd.concat([*rest, batch.iloc[:cut]])
            rest = [batch.iloc[cut:]]
            if len(ready):
                yield settle_unit(ready)
        if rest:
            yield settle_unit(pd.concat(rest))

    return run


def in_groups(units: DataFrame) -> DataFrame:
    """Rows of a unit next to each other in one partition, numbered.

    The numbering is what makes the engine keep units whole: a bare
    `repartition` may be dropped when a union below looks partitioned already.
    """
    unit = Window.partitionBy("gid", "chunk").orderBy("kind", "ord")
    return units.select(*_UNIT_COLUMNS, F.row_number().over(unit).alias("n"))


def each_unit(frame: pd.DataFrame) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    arrays = {c: frame[c].to_numpy() for c in frame.columns}
    gid, chunk = arrays["gid"], arrays["chunk"]
    bounds = [*np.nonzero(arrays["n"] == 1)[0].tolist(), len(gid)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield int(gid[lo]), int(chunk[lo]), {c: a[lo:hi] for c, a in arrays.items()}


def per_unit(units: DataFrame, work: Callable, value: str) -> DataFrame:
    """Run `work(arrays of one unit) -> (columns, short)` for every unit.

    A unit that is short of events adds a row with `value` = -1.
    """
    names = ["gid", "chunk", "l_ord", "e_ord", value]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for gid, chunk, arrays in each_unit(frame):
            columns, short = work(arrays)
            parts = {n: list(columns.get(n, [0] * len(columns["l_ord"]))) for n in names[2:]}
            if short:
                for name in names[2:]:
                    parts[name].append(-1)
            if parts["l_ord"]:
                found.append(pd.DataFrame({"gid": gid, "chunk": chunk, **parts}))
        return pd.concat(found) if found else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    schema = f"gid bigint, chunk int, l_ord bigint, e_ord bigint, {value} bigint"
    return in_groups(units).mapInPandas(by_unit(run), schema)


def is_short(u: dict, left, l_ord: list, distance: list, tolerance_us: int) -> bool:
    """Whether a row may have a better event beyond what its unit sees.

    Ledger rows of a unit and those served come in arrival order.
    """
    t = u["t"][left]
    needed = np.full(len(t), tolerance_us, dtype=np.int64)
    needed[np.searchsorted(u["ord"][left], l_ord)] = distance
    edge = np.minimum(t - u["seen_from"][left], u["seen_to"][left] - t)
    return bool((needed > edge).any())


def settle(units: DataFrame, tolerance_us: int, chunked: bool = False) -> DataFrame:
    """Serve the ledger rows of every unit: (gid, chunk, l_ord, e_ord, delta_us)."""

    def work(u: dict[str, np.ndarray]):
        left, event, claim = (u["kind"] == k for k in (LEDGER, EVENT, CLAIM))
        l_ord, e_ord, delta = serve(
            u["ord"][left], u["t"][left], u["ord"][event], u["t"][event],
            tolerance_us, u["ord"][claim], u["mark"][claim],
        )
        short = chunked and is_short(u, left, l_ord, delta, tolerance_us)
        return {"l_ord": l_ord, "e_ord": e_ord, "delta_us": delta}, short

    return per_unit(units, work, "delta_us")


def _as_claims(met: DataFrame) -> DataFrame:
    """Rows (gid, seen_by, e_ord, l_ord) as claim rows of the unit that sees them."""
    return as_units(
        met.select(
            "gid", F.col("seen_by").alias("chunk"), F.lit(CLAIM).alias("kind"),
            F.col("e_ord").alias("ord"), F.col("l_ord").alias("mark"),
        )
    )


def changed_units(claims: DataFrame, known: DataFrame | None) -> DataFrame:
    """Units with a claim that is in one of the two sets only."""
    both = claims if known is None else claims.unionByName(known)
    return both.groupBy("gid", "chunk", "ord", "mark").count().where("count = 1").select(*_UNIT)


class Rounds:
    """Settling chunks until what they know of each other no longer changes."""

    def __init__(self, chunks: Chunks):
        self.chunks = chunks
        self.out = materialise(chunks.settle())
        self.known: DataFrame | None = None

    @property
    def pairs(self) -> DataFrame:
        return self.out.where("delta_us >= 0")

    def again(self, *others: DataFrame) -> bool:
        """One round, given what `others` took; False if nothing was to do."""
        short = materialise(self.out.where("delta_us < 0").select(*_UNIT))
        if not short.isEmpty():
            self.chunks.widen(short)
        claims = self.chunks.claims(self.pairs, *others)
        news = changed_units(claims, self.known).unionByName(short).distinct()
        news = materialise(news)
        if news.isEmpty():
            return False
        kept = self.out.join(news, _UNIT, "left_anti")
        self.out = materialise(kept.unionByName(self.chunks.settle(news, claims)))
        self.known = claims
        return True


def settle_chunked(rows: DataFrame, cells: DataFrame, tolerance_us: int) -> DataFrame:
    """Blocks of several chunks: settle, exchange what was taken, settle again
    where that changed something."""
    rounds = Rounds(Chunks(rows, cells, tolerance_us))
    while rounds.again():
        pass
    return rounds.pairs
