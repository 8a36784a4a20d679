"""Rules per source and asset: listing, updating, and what applies where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import schemas

_VALUES = ["match_strategy", "tolerance_seconds", "escalation_age_minutes", "auto_resolve_timing", "config"]


def list_rules(rules: DataFrame, source: str | None = None) -> DataFrame:
    found = rules if source is None else rules.where(F.col("source") == source)
    return found.orderBy("source", F.asc_nulls_last("asset"))


def rules_for(rules: DataFrame, source: str, asset: str | None = None) -> DataFrame:
    found = rules.where(F.col("source") == source)
    if asset is None:
        return found
    return found.where((F.col("asset") == asset) | F.col("asset").isNull())


def applicable_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """For every (source, asset): its own rule and the one for all assets.

    (source, asset) is unique among rules, so a key meets at most two.
    """
    values = [c for c in rules.columns if c not in ("source", "asset")]
    own = keys.join(rules.where("asset IS NOT NULL"), ["source", "asset"]).select(
        "source", "asset", F.col("asset").alias("rule_asset"), *values
    )
    general = rules.where("asset IS NULL").drop("asset")
    shared = keys.join(general, "source").select(
        "source", "asset", F.lit(None).cast("string").alias("rule_asset"), *values
    )
    return own.unionByName(shared)


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after the changes: values given replace, values not given stay.

    Changes hold at most one row per (source, asset).
    """
    new = changes.select(
        F.col("source").alias("n_source"), F.col("asset").alias("n_asset"),
        *[F.col(c).alias(f"n_{c}") for c in _VALUES],
    )
    on = F.col("source").eqNullSafe(F.col("n_source")) & F.col("asset").eqNullSafe(F.col("n_asset"))
    merged = rules.join(new, on, "full_outer")
    defaults = {
        "match_strategy": F.lit(schemas.DEFAULT_STRATEGY),
        "tolerance_seconds": F.lit(schemas.DEFAULT_TOLERANCE_SECONDS).cast("bigint"),
        "escalation_age_minutes": F.lit(schemas.DEFAULT_ESCALATION_MINUTES).cast("bigint"),
        "auto_resolve_timing": F.lit(schemas.DEFAULT_AUTO_RESOLVE),
        "config": F.lit("{}"),
    }
    return merged.select(
        F.coalesce("source", "n_source").alias("source"),
        F.coalesce("asset", "n_asset").alias("asset"),
        *[F.coalesce(F.col(f"n_{c}"), F.col(c), defaults[c]).alias(c) for c in _VALUES],
    )


def strategy_per_source(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """The strategy of the first rule of each source; EXACT without one.

    First = in listing order. A name that is not known means EXACT.
    """
    listing = Window.partitionBy("source").orderBy(F.asc_nulls_last("asset"))
    first = rules.withColumn("_n", F.row_number().over(listing)).where("_n = 1")
    known = F.when(F.col("match_strategy").isin(*schemas.STRATEGIES), F.col("match_strategy"))
    return (
        sources.select("source")
        .distinct()
        .join(first.select("source", "match_strategy"), "source", "left")
        .select("source", F.coalesce(known, F.lit(schemas.DEFAULT_STRATEGY)).alias("strategy"))
    )


def with_rule_value(rows: DataFrame, rules: DataFrame, column: str, default: Column) -> DataFrame:
    """Add `column` from the most specific rule: asset, then source, then default.

    `rule_level` says which one it was. Rules are not assumed small: the
    session decides from their size whether to broadcast them.
    """
    own = rules.where("asset IS NOT NULL").select(
        "source", "asset", F.col(column).alias("_own"), F.lit(True).alias("_has_own")
    )
    general = rules.where("asset IS NULL").select(
        "source", F.col(column).alias("_general"), F.lit(True).alias("_has_general")
    )
    joined = rows.join(own, ["source", "asset"], "left").join(general, "source", "left")
    level = (
        F.when(F.col("_has_own"), F.lit("asset"))
        .when(F.col("_has_general"), F.lit("source"))
        .otherwise(F.lit("default"))
    )
    return joined.select(
        *[F.col(c) for c in rows.columns],
        F.coalesce("_own", "_general", default).alias(column),
        level.alias("rule_level"),
    )


def with_tolerance(rows: DataFrame, rules: DataFrame) -> DataFrame:
    default = F.lit(schemas.DEFAULT_TOLERANCE_SECONDS).cast("bigint")
    return with_rule_value(rows, rules, "tolerance_seconds", default)


def with_escalation_age(rows: DataFrame, rules: DataFrame) -> DataFrame:
    default = F.lit(schemas.DEFAULT_ESCALATION_MINUTES).cast("bigint")
    return with_rule_value(rows, rules, "escalation_age_minutes", default)


def with_auto_resolve(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return with_rule_value(rows, rules, "auto_resolve_timing", F.lit(schemas.DEFAULT_AUTO_RESOLVE))
