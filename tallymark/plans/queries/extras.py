"""Balances over windows, repeated runs, latency, mismatched amounts, cursor chains."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tallymark.operators import balances as bl
from tallymark.operators import checks as ck
from tallymark.operators import sketches as sk
from tallymark.plans.fixtures import view, with_inputs
from tallymark.plans.queries.matching import EXACT, SIDES, _exact
from tallymark.plans.registry import money, query, us
from tallymark.sources import cursors as cu

START = datetime(1997, 1, 1, tzinfo=timezone.utc)
END = datetime(1999, 1, 1, tzinfo=timezone.utc)
_S, _E = "TIMESTAMP '1997-01-01 00:00:00'", "TIMESTAMP '1999-01-01 00:00:00'"


def _last(until: str, name: str) -> str:
    return (
        f"(SELECT source, asset, max_by(balance, (ts, ord)) AS {name}, max(ts) AS at FROM fx_snapshots"
        f" WHERE ts <= {until} GROUP BY source, asset)"
    )


@query(
    "rollforward_opening",
    with_inputs(["fx_snapshots", "fx_flows"], f""", o AS {_last(_S, 'opening')}, c AS {_last(_E, 'closing')},
m AS (SELECT source, asset, sum(amount) AS net_flow FROM fx_flows WHERE ts > {_S} AND ts <= {_E} GROUP BY source, asset),
k AS (SELECT source, asset FROM o UNION SELECT source, asset FROM c UNION SELECT source, asset FROM m),
j AS (SELECT k.source, k.asset, coalesce(opening, 0) AS opening, coalesce(net_flow, 0) AS net_flow, coalesce(closing, 0) AS closing
  FROM k LEFT JOIN o USING (source, asset) LEFT JOIN c USING (source, asset) LEFT JOIN m USING (source, asset))
SELECT source, asset, CAST(opening AS DECIMAL(38,8)) AS opening, CAST(net_flow AS DECIMAL(38,8)) AS net_flow,
  CAST(opening + net_flow AS DECIMAL(38,8)) AS expected_closing, CAST(closing AS DECIMAL(38,8)) AS actual_closing,
  CAST(closing - opening - net_flow AS DECIMAL(38,8)) AS delta, closing = opening + net_flow AS matched FROM j"""),
)
def rollforward_opening(spark, d):
    rows = bl.roll_forward_window(
        view(spark, d, "fx_flows"), view(spark, d, "fx_snapshots"), START, END
    )
    names = ("opening", "net_flow", "expected_closing", "actual_closing", "delta")
    return rows.select("source", "asset", *[money(c) for c in names], "matched")


@query(
    "balance_snapshots",
    with_inputs(["fx_snapshots", "fx_flows"], f""", s AS {_last("TIMESTAMP '9999-01-01 00:00:00'", 'reported')},
t AS (SELECT s.source, s.asset, sum(f.amount) AS total FROM s JOIN fx_flows f ON s.source = f.source AND s.asset = f.asset AND f.ts <= s.at GROUP BY ALL)
SELECT s.source, s.asset, CAST(reported AS DECIMAL(38,8)) AS reported, epoch_us(s.at) AS reported_us,
  CAST(coalesce(total, 0) AS DECIMAL(38,8)) AS ledger_total, CAST(reported - coalesce(total, 0) AS DECIMAL(38,8)) AS delta,
  reported = coalesce(total, 0) AS matched FROM s LEFT JOIN t ON s.source = t.source AND s.asset = t.asset"""),
)
def balance_snapshots(spark, d):
    rows = bl.check_snapshots(view(spark, d, "fx_flows"), view(spark, d, "fx_snapshots"))
    return rows.select(
        "source", "asset", money("reported"), us("reported_at", "reported_us"), money("ledger_total"),
        money("delta"), "matched",
    )


@query(
    "new_breaks_only",
    with_inputs(["fx_breaks"], """, found AS (SELECT concat(break_id, '-again') AS break_id, type, classification, source, asset, reference,
  internal_amount, CASE WHEN substr(break_id, -1) = '3' THEN external_amount + 1 ELSE external_amount END AS external_amount FROM fx_breaks)
SELECT break_id, type, source, asset, reference, CAST(internal_amount AS DECIMAL(38,8)) AS internal_amount,
  CAST(external_amount AS DECIMAL(38,8)) AS external_amount FROM found f
WHERE NOT EXISTS (SELECT 1 FROM fx_breaks b WHERE b.status = 'OPEN' AND b.type = f.type AND b.source = f.source AND b.asset = f.asset
  AND b.reference IS NOT DISTINCT FROM f.reference AND b.internal_amount IS NOT DISTINCT FROM f.internal_amount
  AND b.external_amount IS NOT DISTINCT FROM f.external_amount)"""),
)
def new_breaks_only(spark, d):
    """The same breaks found by a second run, some with another amount."""
    breaks = view(spark, d, "fx_breaks")
    other = F.substring("break_id", -1, 1) == "3"
    amount = F.when(other, F.col("external_amount") + 1).otherwise(F.col("external_amount"))
    found = breaks.withColumn("external_amount", amount.cast("decimal(28,8)")).withColumn(
        "break_id", F.concat("break_id", F.lit("-again"))
    )
    return ck.new_breaks_only(found, breaks).select(
        "break_id", "type", "source", "asset", "reference", money("internal_amount"), money("external_amount")
    )


@query(
    "detection_latency",
    with_inputs(["fx_external"], """, t AS (SELECT source, (epoch_us(date_trunc('day', ts) + INTERVAL '600' SECOND) - epoch_us(ts)) AS late_us FROM fx_external WHERE ts IS NOT NULL)
SELECT source, count(*) AS events, count(*) FILTER (WHERE late_us <= 60000000) AS within_1_min,
  count(*) FILTER (WHERE late_us <= 300000000) AS within_limit, count(*) FILTER (WHERE late_us > 300000000) AS over_limit,
  CAST(max(late_us) / 1000000 AS DOUBLE) AS max_seconds FROM t GROUP BY source"""),
)
def detection_latency(spark, d):
    """Events are checked ten minutes after the start of their day."""
    rows = view(spark, d, "fx_external")
    checked = F.date_trunc("day", "ts") + F.make_dt_interval(secs=F.lit(600))
    return ck.detection_latency(rows, F.col("ts"), checked).drop("p95_seconds")


@query(
    "amount_mismatch_pairs",
    with_inputs(SIDES, EXACT + """, a AS (SELECT *, row_number() OVER (PARTITION BY reference, asset ORDER BY ord) AS n FROM open_l WHERE reference IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY reference, asset ORDER BY ord) AS n FROM open_e WHERE reference IS NOT NULL)
SELECT a.reference, a.asset, a.ord AS l_ord, b.ord AS e_ord, CAST(a.amount AS DECIMAL(38,8)) AS internal_amount,
  CAST(coalesce(b.amount, 0) AS DECIMAL(38,8)) AS external_amount, CAST(coalesce(b.amount, 0) - a.amount AS DECIMAL(38,8)) AS difference
FROM a JOIN b ON a.reference = b.reference AND a.asset = b.asset AND a.n = b.n WHERE a.amount <> coalesce(b.amount, 0)"""),
)
def amount_mismatch_pairs(spark, d):
    return ck.amount_mismatches(_exact(spark, d)).select(
        "reference", "asset", "l_ord", "e_ord", money("internal_amount"), money("external_amount"),
        money("difference"),
    )



@query(
    "latency_quantiles",
    with_inputs(["fx_external"], """, t AS (SELECT source, greatest(0, epoch_us(date_trunc('day', ts) + INTERVAL '600' SECOND) - epoch_us(ts) + ord % 1000 * 1000003) AS v FROM fx_external WHERE ts IS NOT NULL),
e AS (SELECT source, count(*) AS events, CAST(quantile_disc(v, 0.95) AS BIGINT) AS p FROM t GROUP BY source),
s AS (SELECT *, greatest(length(bin(p)) - 6, 0) AS shift FROM e),
b AS (SELECT *, (p >> shift) << shift AS low, (((p >> shift) + 1) << shift) - 1 AS high FROM s)
SELECT source, events, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high,
  (SELECT count(*) FROM t WHERE t.source = b.source AND t.v < b.low) + 1 AS rank_low, (SELECT count(*) FROM t WHERE t.source = b.source AND t.v <= b.high) AS rank_high FROM b"""),
)
def latency_quantiles(spark, d):
    """The 95th percentile per source from sketches per source and day, with the ranks it stands for."""
    rows = view(spark, d, "fx_external")
    checked = F.date_trunc("day", "ts") + F.make_dt_interval(secs=F.lit(600))
    late = F.unix_micros(checked) - F.unix_micros("ts") + F.col("ord") % 1000 * 1000003
    daily = sk.latency_sketch(rows, late, "source", F.to_date("ts").alias("day"))
    return sk.quantiles(sk.merged(daily, "source"), 0.95, "source")


@query(
    "balance_windows",
    with_inputs(["fx_snapshots", "fx_flows"], """,
s AS (SELECT source, asset, ts, max_by(balance, ord) AS balance, lag(ts) OVER w AS opened, lag(max_by(balance, ord)) OVER w AS opening
  FROM fx_snapshots WHERE ts IS NOT NULL GROUP BY source, asset, ts WINDOW w AS (PARTITION BY source, asset ORDER BY ts)),
f AS (SELECT s.source, s.asset, s.ts, sum(f.amount) AS net FROM fx_flows f ASOF JOIN s ON f.source = s.source AND f.asset = s.asset AND f.ts <= s.ts GROUP BY ALL)
SELECT s.source, s.asset, epoch_us(s.opened) AS opened_us, epoch_us(s.ts) AS closed_us, CAST(s.opening AS DECIMAL(38,8)) AS opening,
  CAST(coalesce(f.net, 0) AS DECIMAL(38,8)) AS net_flow, CAST(s.balance AS DECIMAL(38,8)) AS actual_closing,
  CAST(s.balance - s.opening - coalesce(f.net, 0) AS DECIMAL(38,8)) AS delta, s.balance - s.opening - coalesce(f.net, 0) = 0 AS matched
FROM s LEFT JOIN f ON f.source = s.source AND f.asset = s.asset AND f.ts = s.ts WHERE s.opened IS NOT NULL"""),
)
def balance_windows(spark, d):
    """All pairs of consecutive snapshots at once."""
    return bl.all_windows(view(spark, d, "fx_flows"), view(spark, d, "fx_snapshots")).select(
        "source", "asset", us("opened_at", "opened_us"), us("closed_at", "closed_us"), money("opening"), money("net_flow"),
        money("actual_closing"), money("delta"), "matched")


# Pages of five entries per account; by account % 7: 3 has a page missing, 4 runs in a circle, 5 has one twice.
_PAGES = """
SELECT acct, p, seq, CASE WHEN p = 0 THEN NULL ELSE CAST(p * 10 AS VARCHAR(20)) END AS cursor,
  CASE WHEN p < pages - 1 THEN CAST(p * 10 + 10 AS VARCHAR(20)) WHEN acct % 7 = 4 AND pages > 2 THEN '10' END AS next_cursor, key, line
FROM (SELECT *, CAST(floor(seq / 5) AS BIGINT) AS p, CAST(ceil(total / 5.0) AS BIGINT) AS pages FROM (
  SELECT l_suppkey AS acct, l_orderkey AS key, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS seq,
    count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) r) t
WHERE acct % 7 <> 3 OR p <> 2"""
_FOLLOWED = f"""WITH RECURSIVE x AS (SELECT acct, p, seq, cursor, next_cursor, key, line FROM ({_PAGES}) y),
page AS (SELECT DISTINCT acct, cursor, next_cursor FROM x),
chain AS (
  SELECT acct, cursor, next_cursor, 0::BIGINT AS place, [''] AS seen FROM page WHERE cursor IS NULL
  UNION ALL SELECT p.acct, p.cursor, p.next_cursor, c.place + 1, list_append(c.seen, p.cursor) FROM chain c
  JOIN page p ON p.acct = c.acct AND p.cursor = c.next_cursor WHERE NOT list_contains(c.seen, p.cursor))"""
PAGE_LIMIT = 50


def _pages(spark, d):
    """Landed pages: one row each, one account's second page delivered again later."""
    base = spark.read.parquet(f"{d}/lineitem.parquet")
    base.createOrReplaceTempView("lineitem")
    rows = spark.sql(_PAGES)
    item = F.struct(F.col("seq").alias("k"), F.concat_ws("-", F.col("key").cast("string"), F.col("line").cast("string")).alias("entry_id"))
    pages = rows.groupBy(F.concat(F.lit("S"), F.col("acct")).alias("account_id"), "acct", "cursor", "next_cursor").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["entry_id"].alias("entry_id"))).alias("entries"), F.min("seq").alias("ord"))
    twice = pages.where("acct % 7 = 5 AND cursor = '10'").withColumn("ord", F.col("ord") + 1_000_000_000)
    return pages.unionByName(twice).drop("acct")


@query(
    "page_items",
    _FOLLOWED + f"""
SELECT account_id, place, entry_id FROM (
  SELECT concat('S', x.acct) AS account_id, c.place, concat(key, '-', line) AS entry_id, row_number() OVER (PARTITION BY x.acct ORDER BY c.place, x.seq) AS n
  FROM x JOIN chain c ON c.acct = x.acct AND c.cursor IS NOT DISTINCT FROM x.cursor) t WHERE n <= {PAGE_LIMIT}""",
)
def page_items(spark, d):
    """The first entries of each account, cursor by cursor."""
    return cu.items_in_order(cu.numbered_pages(_pages(spark, d)), PAGE_LIMIT).select("account_id", "place", F.col("item.entry_id").alias("entry_id"))


@query(
    "page_chains",
    _FOLLOWED + """,
last AS (SELECT acct, arg_max(coalesce(next_cursor, ''), place) AS target, count(*) AS pages FROM chain GROUP BY acct)
SELECT concat('S', l.acct) AS account_id, l.pages, CASE WHEN l.acct % 7 = 5 AND EXISTS (SELECT 1 FROM page p WHERE p.acct = l.acct AND p.cursor = '10') THEN 1 ELSE 0 END::BIGINT AS repeated,
  (SELECT count(*) FROM page p WHERE p.acct = l.acct) - l.pages AS unreached,
  target <> '' AND NOT EXISTS (SELECT 1 FROM page p WHERE p.acct = l.acct AND p.cursor = target) AS missing,
  target <> '' AND EXISTS (SELECT 1 FROM page p WHERE p.acct = l.acct AND p.cursor = target) AS cycle FROM last l""",
)
def page_chains(spark, d):
    """What became of each account's pages."""
    return cu.chain_reports(cu.numbered_pages(_pages(spark, d)))
