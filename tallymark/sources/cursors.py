"""Pages of account ledgers put in the order in which cursors lead through them.

A page names the next by its cursor. All accounts are followed at once, by
doubling: with the pages that lie 2^k steps behind each page known, the first
2^k pages of every chain give the next 2^k, so that a chain of n pages takes
log2(n) rounds, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.ranking import first_rows
from tallymark.session import materialise

_PAGE = ["account_id", "cursor"]


def _present(name: str):
    """A cursor that leads somewhere; absent, empty and zero ones do not."""
    return F.when(F.coalesce(F.trim(name), F.lit("")).isin("", "0"), F.lit(None)).otherwise(F.trim(name))


def numbered_pages(pages: DataFrame) -> DataFrame:
    """`pages` (account_id, cursor, next_cursor, ord, ...) plus `place`: the steps from the first page, null if no chain leads there.

    The first page of an account has no cursor. Of pages with one cursor the
    earliest by ord counts, others have `repeated`. A chain that comes back to
    one of its pages ends there.
    """
    rows = pages.withColumn("cursor", _present("cursor")).withColumn("next_cursor", _present("next_cursor"))
    same = Window.partitionBy(*_PAGE).orderBy("ord")
    rows = materialise(rows.withColumn("repeated", F.row_number().over(same) > 1))
    links = rows.where("NOT repeated").select("account_id", F.coalesce("cursor", F.lit("")).alias("at"), F.col("next_cursor").alias("to"))
    targets = links.select("account_id", F.col("at").alias("to"))
    jump = materialise(links.where("to IS NOT NULL").join(targets, ["account_id", "to"], "left_semi"))
    reached = materialise(links.where("at = ''").select("account_id", "at", F.lit(0).cast("bigint").alias("place")))
    step, before = 1, -1
    # Ends when a round reaches nothing new: after log2 of the longest chain.
    while (count := reached.count()) != before:
        before = count
        further = reached.join(jump, ["account_id", "at"]).select("account_id", F.col("to").alias("at"), (F.col("place") + step).alias("place"))
        reached = materialise(reached.unionByName(further).groupBy("account_id", "at").agg(F.min("place").alias("place")))
        second = jump.select("account_id", F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = materialise(jump.join(second, ["account_id", "to"]).select("account_id", "at", F.col("_to").alias("to")))
        step *= 2
    places = reached.select("account_id", F.col("at").alias("_at"), F.col("place"))
    found = rows.withColumn("_at", F.coalesce("cursor", F.lit(""))).join(places, ["account_id", "_at"], "left").drop("_at")
    return found.withColumn("place", F.when(~F.col("repeated"), F.col("place")))


def chain_reports(numbered: DataFrame) -> DataFrame:
    """Per account: pages in its chain, repeated and unreached ones, and whether the chain ends at a missing page or in a cycle."""
    last = F.max_by("next_cursor", F.when(F.col("place").isNotNull(), F.col("place")))
    per_account = numbered.groupBy("account_id").agg(
        F.count("place").alias("pages"), F.count_if("repeated").alias("repeated"),
        F.count_if(F.col("place").isNull() & ~F.col("repeated")).alias("unreached"), last.alias("_to"),
    )
    there = numbered.where("NOT repeated").select("account_id", F.col("cursor").alias("_to"), F.lit(True).alias("_there"))
    ends = per_account.join(there.where("_to IS NOT NULL"), ["account_id", "_to"], "left")
    leads = F.col("_to").isNotNull() & (F.col("pages") > 0)
    return ends.select(
        "account_id", "pages", "repeated", "unreached", (leads & F.col("_there").isNull()).alias("missing"),
        (leads & F.col("_there").isNotNull()).alias("cycle"))


def items_in_order(numbered: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries of the pages that were reached, with `place` and `k`; the first `limit` of each account in chain order."""
    items = numbered.where("place IS NOT NULL").select("account_id", "place", F.posexplode("entries").alias("k", "item"))
    if limit is None:
        return items
    # A page has room for 2^24 entries in an order of entries.
    ordered = items.withColumn("ord", F.col("place") * (1 << 24) + F.col("k"))
    return first_rows(ordered, ["account_id"], limit).drop("ord")
