"""Exact pairing, duplicates and balance roll-forward."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions import ranking
from tallymark.functions.scalars import amount_or_zero, text_or_empty

_LEDGER_SIDE, _EXTERNAL_SIDE = 0, 1
ENTRY = ["ord", "external_event_id", "source", "asset", "reference", "amount", "counterparty", "ts"]


@dataclass(frozen=True)
class MatchOutcome:
    """What a strategy found. Strategies leave the parts they do not produce empty.

    `pairing` has one row per ledger row, external row or pair: nested structs
    `l` and `e` (null on the missing side) and `delta_seconds`.
    """

    strategy: str
    pairing: DataFrame
    balances: DataFrame
    duplicates: DataFrame

    @property
    def matched(self) -> DataFrame:
        both = self.pairing.where("l IS NOT NULL AND e IS NOT NULL")
        return both.select(F.lit(self.strategy).alias("strategy"), "l", "e", "delta_seconds")

    @property
    def unmatched_ledger(self) -> DataFrame:
        reason = "no_amount_or_time" if self.strategy == "FUZZY" else "no_external"
        rows = self.pairing.where("l IS NOT NULL AND e IS NULL").select("l.*")
        return rows.select(*schemas.columns(schemas.LEDGER), F.lit(reason).alias("reason"))

    @property
    def unmatched_external(self) -> DataFrame:
        rows = self.pairing.where("e IS NOT NULL AND l IS NULL").select("e.*")
        return rows.select(*schemas.columns(schemas.EXTERNAL), F.lit("no_ledger").alias("reason"))


def side_by_side(ledger: DataFrame, external: DataFrame) -> DataFrame:
    """Both inputs as rows (side, entry)."""
    entry = [F.col(c) for c in ENTRY]
    left = ledger.withColumn("external_event_id", F.lit(None).cast("string")).withColumn(
        "source", F.lit(None).cast("string")
    )
    return left.select(F.lit(_LEDGER_SIDE).alias("side"), *entry).unionByName(
        external.select(F.lit(_EXTERNAL_SIDE).alias("side"), *entry)
    )


def _pairs(numbered: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per (keys, n) with the entries of both sides."""
    entry = F.struct(*columns)
    return numbered.groupBy(*keys, "n").agg(
        F.max(F.when(F.col("side") == _LEDGER_SIDE, entry)).alias("l"),
        F.max(F.when(F.col("side") == _EXTERNAL_SIDE, entry)).alias("e"),
    )


def pair_in_order(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Pair the n-th ledger row of a key with its n-th external row.

    Input: side, ord, key and payload columns. Output: keys, n, l, e.

    When pairing asks only for equality, taking the earliest unused candidate
    for every ledger row in turn gives exactly this pairing. An ordinary key
    is read from one shuffle: numbering and pairing share its partitioning.
    Rows of hot keys are numbered in slices and then meet by key and number.
    """
    columns = [c for c in rows.columns if c not in ("side", *keys)]
    usual, hot = ranking.split_by_heat(rows, keys, hot_rows)
    in_side = Window.partitionBy(*keys, "side").orderBy("ord")
    usual = usual.repartition(*keys).withColumn("n", F.row_number().over(in_side).cast("bigint"))
    usual = _pairs(usual, keys, columns)
    if hot is None:
        return usual
    return usual.unionByName(
        _pairs(ranking.number_hot_rows(hot, [*keys, "side"], "n"), keys, columns)
    )


def with_match_keys(sides: DataFrame) -> DataFrame:
    """Rows of `side_by_side` with the values that must be equal for an exact pair.

    Absent external references and amounts compare as '' and 0, and an empty
    counterparty is the same as none.
    """
    is_external = F.col("side") == _EXTERNAL_SIDE
    return sides.select(
        "*",
        F.when(is_external, text_or_empty("reference")).otherwise(F.col("reference")).alias("k_ref"),
        F.col("asset").alias("k_asset"),
        F.when(is_external, amount_or_zero("amount")).otherwise(F.col("amount")).alias("k_amount"),
        text_or_empty("counterparty").alias("k_party"),
    )


_MATCH_KEY = ["k_ref", "k_asset", "k_amount", "k_party"]


def pair_exact(
    ledger: DataFrame, external: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Reference, asset, amount and counterparty all equal; each event used once.

    Events also get `copy`, their number among those with the same stored
    reference and amount. Rows are shuffled by these two alone, which serves
    pairing and counting copies at once.
    """
    rows = with_match_keys(side_by_side(ledger, external))
    place = ["k_ref", "k_amount"]
    same = [*place, "side", "reference", "amount"]
    usual, hot = ranking.split_by_heat(rows, place, hot_rows)
    columns = [*ENTRY, "copy"]

    def number(part: list[str]):
        return F.row_number().over(Window.partitionBy(*part).orderBy("ord")).cast("bigint")

    usual = usual.repartition(*place).withColumn("copy", number(same))
    usual = _pairs(usual.withColumn("n", number([*_MATCH_KEY, "side"])), _MATCH_KEY, columns)
    if hot is not None:
        hot = ranking.number_hot_rows(hot, same, "copy")
        hot = ranking.number_hot_rows(hot, [*_MATCH_KEY, "side"], "n")
        usual = usual.unionByName(_pairs(hot, _MATCH_KEY, columns))
    return usual.select("l", "e")


def duplicates_in(pairing: DataFrame) -> DataFrame:
    """The second copy of every event that has one, from an exact pairing."""
    return pairing.where("e.copy = 2").select(*[f"e.{c}" for c in schemas.columns(schemas.EXTERNAL)])


def count_exact(ledger: DataFrame, external: DataFrame) -> DataFrame:
    """matched, unmatched and duplicates of an exact match as one row.

    Counting needs no pairs: a key has as many as its smaller side has rows.
    All sums are combined before the shuffle, so hot keys need no care.
    """
    sides = with_match_keys(side_by_side(ledger, external)).groupBy(*_MATCH_KEY).agg(
        F.count_if(F.col("side") == _LEDGER_SIDE).alias("n_l"),
        F.count_if(F.col("side") == _EXTERNAL_SIDE).alias("n_e"),
    )
    zero = F.lit(0).cast("bigint")
    paired = sides.agg(
        F.sum(F.least("n_l", "n_e")).alias("matched"),
        F.sum(F.abs(F.col("n_l") - F.col("n_e"))).alias("unmatched"),
        zero.alias("duplicates"),
    )
    copies = external.groupBy("reference", "amount").agg(F.count("*").alias("n"))
    copied = copies.agg(
        zero.alias("matched"), zero.alias("unmatched"), F.count_if(F.col("n") > 1).alias("duplicates")
    )
    return paired.unionByName(copied).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("matched", "unmatched", "duplicates")]
    )


def find_duplicates(external: DataFrame) -> DataFrame:
    """The second event with the same stored reference and amount, once per pair of values.

    Null equals null here. The limit of two per key is applied before the
    shuffle, so a key with any number of copies sends two rows per task.
    """
    by_key = Window.partitionBy("reference", "amount").orderBy("ord")
    numbered = external.withColumn("_n", F.row_number().over(by_key))
    return numbered.where("_n = 2").select(*schemas.columns(schemas.EXTERNAL))


def roll_forward(ledger: DataFrame, external: DataFrame) -> DataFrame:
    """Per asset with external flows: sum of flows against the ledger total.

    Opening is 0. `source` is the source of the very first external row.
    """
    # Sources are few, so this leaves a few rows per asset; only fixed-width
    # values are aggregated, which keeps it a hash aggregation.
    flows = external.groupBy("asset", "source").agg(F.sum("amount").alias("_flow"))
    first_row = external.agg(F.min(F.struct("ord", "source"))["source"].alias("source")).scalar()
    flows = (
        flows.withColumn("_source", first_row)
        .groupBy("asset", F.col("_source").alias("source"))
        .agg(F.sum("_flow").cast(schemas.MATCH_MONEY).alias("net_flow"))
        .where("net_flow IS NOT NULL")
    )
    expected = ledger.groupBy("asset").agg(F.sum("amount").alias("_expected"))
    zero = F.lit(0).cast(schemas.MATCH_MONEY)
    same_asset = F.col("asset").eqNullSafe(F.col("_asset"))
    expected = expected.withColumnRenamed("asset", "_asset")
    joined = flows.join(expected, same_asset, "left").withColumn(
        "expected_closing", F.coalesce("_expected", zero)
    )
    delta = (F.col("net_flow") - F.col("expected_closing")).cast(schemas.MATCH_MONEY)
    return joined.select(
        "asset",
        "source",
        zero.alias("opening"),
        "net_flow",
        "expected_closing",
        F.col("net_flow").alias("actual_closing"),
        delta.alias("delta"),
        (F.col("net_flow") == F.col("expected_closing")).alias("matched"),
    )


def roll_forward_leftovers(external: DataFrame) -> DataFrame:
    """External rows that no balance covers: those without an amount."""
    return external.where("amount IS NULL")


def key_overlap(ledger: DataFrame, external: DataFrame) -> DataFrame:
    """Per (reference, asset) found on both sides: row counts.

    Counted per side first, so the join never multiplies rows.
    """
    left = ledger.groupBy("reference", "asset").agg(F.count("*").alias("ledger_rows"))
    right = external.groupBy("reference", "asset").agg(F.count("*").alias("external_rows"))
    return left.join(right, ["reference", "asset"])


def empty_balances(like: DataFrame) -> DataFrame:
    spark = like.sparkSession
    money = schemas.MATCH_MONEY.simpleString()
    return spark.createDataFrame(
        [],
        f"asset string, source string, opening {money}, net_flow {money}, expected_closing {money},"
        f" actual_closing {money}, delta {money}, matched boolean",
    )


def as_pairing(rows: DataFrame, side: str) -> DataFrame:
    """Rows of one side only, in the shape of `MatchOutcome.pairing`."""
    entry = F.struct(*[F.col(c) for c in ENTRY])
    nothing = F.lit(None)
    kind = rows.select(entry.alias("x")).schema["x"].dataType
    left, right = (entry, nothing.cast(kind)) if side == "l" else (nothing.cast(kind), entry)
    return rows.select(left.alias("l"), right.alias("e"))


def match_exact(
    ledger: DataFrame, external: DataFrame, hot_rows: int | None = None
) -> MatchOutcome:
    pairing = pair_exact(ledger, external, hot_rows).withColumn(
        "delta_seconds", F.lit(None).cast("decimal(20,6)")
    )
    return MatchOutcome("EXACT", pairing, empty_balances(ledger), duplicates_in(pairing))


def match_balances(ledger: DataFrame, external: DataFrame) -> MatchOutcome:
    leftovers = as_pairing(roll_forward_leftovers(external), "e").withColumn(
        "delta_seconds", F.lit(None).cast("decimal(20,6)")
    )
    none = external.limit(0).select(*schemas.columns(schemas.EXTERNAL))
    return MatchOutcome("BALANCE_ROLLFORWARD", leftovers, roll_forward(ledger, external), none)
