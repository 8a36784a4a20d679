"""Named queries over the benchmark tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.scalars import micros, report_money

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RUN_ID = "run-1"
RUN_SOURCE = "RAILS"
TOLERANCE = 300
FUZZY_TOLERANCE = 14_400
NOW = datetime(2024, 1, 1, 2, 30, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-01-01 02:30:00'"


def query(name: str, oracle: str | None = None):
    """Register a query; results compare instants as UTC."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir.rstrip("/"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def money(name: str, out: str | None = None) -> Column:
    return report_money(name).alias(out or name.split(".")[-1])


def us(name: str, out: str | None = None) -> Column:
    """An instant as microseconds, which both engines print alike."""
    return micros(name).alias(out or f"{name}_us")


BREAK_OUT = [
    "break_id", "run_id", "type", "classification", "source", "asset", "reference",
    "internal_amount", "external_amount", "status", "detected_us", "age_seconds",
]


def break_out(frame: DataFrame) -> DataFrame:
    return frame.select(
        *BREAK_OUT[:7], money("internal_amount"), money("external_amount"), "status",
        us("detected_at", "detected_us"), F.col("age_seconds").cast("bigint").alias("age_seconds"),
    )


def sql_break_out(alias: str = "b") -> str:
    a = alias
    return (
        f"{a}.break_id, {a}.run_id, {a}.type, {a}.classification, {a}.source, {a}.asset, {a}.reference,"
        f" CAST({a}.internal_amount AS DECIMAL(38,8)) AS internal_amount,"
        f" CAST({a}.external_amount AS DECIMAL(38,8)) AS external_amount, {a}.status,"
        f" epoch_us({a}.detected_at) AS detected_us"
    )


AGE_SQL = (
    "CAST(greatest(0, floor((epoch_us({now}) - epoch_us({a}.detected_at)) / 1000000)) AS BIGINT)"
)


def age_sql(alias: str = "b", now: str = NOW_SQL) -> str:
    return AGE_SQL.format(now=now, a=alias)
