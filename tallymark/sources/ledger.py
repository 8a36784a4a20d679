"""Ledger rows from landed JSON: postings with nested entries, account pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.ranking import first_rows
from tallymark.functions.scalars import (
    blank_to_null,
    first_present,
    parse_instant,
    signed_amount,
    text_or_empty,
)
from tallymark.operators.breaks import as_column


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All landed files below `path`, one posting per line. Unreadable lines fail the job."""
    return spark.read.schema(schemas.POSTING).option("mode", "FAILFAST").json(path)


def read_account_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of any number of accounts; an account without files adds no rows."""
    return spark.read.schema(schemas.ACCOUNT_PAGE).option("mode", "FAILFAST").json(path)


def _reference(*names: str):
    return F.coalesce(first_present(*names), F.lit(""))


def from_postings(postings: DataFrame) -> DataFrame:
    """One ledger row per nested entry; postings without entries vanish."""
    entries = postings.select(
        *[c for c in postings.columns if c not in ("entries", "created_at")],
        F.col("created_at").alias("posted_at"),
        F.explode("entries").alias("entry"),
    )
    return entries.select(
        _reference("posting_id", "ref_tx_id").alias("reference"),
        text_or_empty("entry.asset").alias("asset"),
        signed_amount("entry.direction", "entry.amount").alias("amount"),
        blank_to_null("entry.account_id").alias("counterparty"),
        F.coalesce(parse_instant("entry.created_at"), parse_instant("posted_at")).alias("ts"),
    )


def from_items(items: DataFrame) -> DataFrame:
    """One ledger row per item of an account ledger."""
    return items.select(
        _reference("posting_id", "entry_id").alias("reference"),
        text_or_empty("asset").alias("asset"),
        signed_amount("direction", "amount").alias("amount"),
        blank_to_null("account_id").alias("counterparty"),
        parse_instant("created_at").alias("ts"),
    )


def from_account_pages(pages: DataFrame) -> DataFrame:
    items = pages.select(F.explode("entries").alias("item")).select("item.*")
    return from_items(items)


def scope(
    ledger: DataFrame,
    accounts: str = "",
    since: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of the listed accounts (comma separated), not older than `since`.

    Without accounts every row is in scope. A limit is shared out evenly, at
    least one row per account, accounts in the order given, oldest rows first.
    """
    names = [a.strip() for a in accounts.split(",") if a.strip()]
    found = ledger if since is None else ledger.where(F.col("ts") >= as_column(since))
    if not names:
        return found if limit is None else found.orderBy("ord").limit(limit)
    found = found.where(F.col("counterparty").isin(names))
    if limit is None:
        return found
    share = max(1, limit // len(names))
    listed = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("counterparty"))
    return first_rows(found, ["counterparty"], share).orderBy(listed, "ord").limit(limit)
