"""Pairing, breaks and runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tallymark.functions.scalars import age_seconds, classify_amount, classify_timing, report_money
from tallymark.operators import breaks as br
from tallymark.operators import matching as mt
from tallymark.operators import rules as rl
from tallymark.operators.fuzzy import match_fuzzy
from tallymark.plans import run
from tallymark.plans.fixtures import table, view, with_inputs
from tallymark.plans.registry import (
    FUZZY_TOLERANCE, NOW, NOW_SQL, RUN_ID, RUN_SOURCE, TOLERANCE, age_sql, break_out, money, query, us,
)

SIDES = ["fx_ledger", "fx_external"]

EXACT = """,
l AS (SELECT *, row_number() OVER (PARTITION BY reference, asset, amount, coalesce(counterparty, '') ORDER BY ord) AS rn FROM fx_ledger),
e AS (SELECT *, row_number() OVER (PARTITION BY coalesce(reference, ''), asset, coalesce(amount, 0), coalesce(counterparty, '') ORDER BY ord) AS rn FROM fx_external),
exact AS (SELECT l.ord AS l_ord, e.ord AS e_ord, l.reference, l.asset, l.amount FROM l JOIN e
  ON l.reference = coalesce(e.reference, '') AND l.asset = e.asset AND l.amount = coalesce(e.amount, 0)
  AND coalesce(l.counterparty, '') = coalesce(e.counterparty, '') AND l.rn = e.rn),
open_l AS (SELECT * FROM fx_ledger WHERE ord NOT IN (SELECT l_ord FROM exact)),
open_e AS (SELECT * FROM fx_external WHERE ord NOT IN (SELECT e_ord FROM exact)),
dup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference, amount ORDER BY ord) AS n FROM fx_external) t WHERE n = 2)
"""

ROLL = """,
flow AS (SELECT asset, sum(amount) AS net_flow FROM fx_external WHERE amount IS NOT NULL GROUP BY asset),
total AS (SELECT asset, sum(amount) AS expected FROM fx_ledger GROUP BY asset),
roll AS (SELECT flow.asset, (SELECT source FROM fx_external ORDER BY ord LIMIT 1) AS source, net_flow,
  coalesce(expected, 0) AS expected FROM flow LEFT JOIN total ON flow.asset = total.asset)
"""


def _breaks_sql(parts: list[str]) -> str:
    """Break rows of the exact run from its leftovers, or of the balance run."""
    head = (
        "SELECT sha256(concat_ws('|', '{run}', '{branch}', {key})) AS break_id, '{run}' AS run_id, '{type}' AS type,"
        " '{cls}' AS classification, {source} AS source, asset, {ref} AS reference,"
        " CAST({internal} AS DECIMAL(38,8)) AS internal_amount, CAST({external} AS DECIMAL(38,8)) AS external_amount,"
        " 'OPEN' AS status, epoch_us({now}) AS detected_us, CAST(0 AS BIGINT) AS age_seconds FROM {rows}"
    )
    run_source = f"'{RUN_SOURCE}'"
    kinds = {
        "ledger": dict(branch="ledger", key="ord", type="TIMING_GAP", cls="TIMING", source=run_source,
                       ref="reference", internal="amount", external="NULL", rows="open_l"),
        "external": dict(branch="external", key="ord", type="MISSING_ENTRY", cls="REAL", source=run_source,
                         ref="reference", internal="NULL", external="amount", rows="open_e"),
        "duplicate": dict(branch="duplicate", key="ord", type="DUPLICATE", cls="REAL", source="source",
                          ref="reference", internal="NULL", external="amount", rows="dup"),
        "balance": dict(branch="balance", key="asset", type="AMOUNT_MISMATCH", cls="REAL", source="source",
                        ref="CAST(NULL AS VARCHAR)", internal="expected", external="net_flow",
                        rows="roll WHERE net_flow <> expected"),
    }
    return " UNION ALL ".join(head.format(run=RUN_ID, now=NOW_SQL, **kinds[p]) for p in parts)


def _sides(spark, d):
    return view(spark, d, "fx_ledger"), view(spark, d, "fx_external")


def _exact(spark, d):
    return mt.match_exact(*_sides(spark, d))


def _detect_args():
    return F.lit(RUN_ID), F.lit(RUN_SOURCE), br.as_column(NOW), TOLERANCE


@query(
    "match_exact",
    with_inputs(SIDES, EXACT + """SELECT l_ord, e_ord, reference, asset, CAST(amount AS DECIMAL(38,8)) AS amount,
  'EXACT' AS strategy FROM exact"""),
)
def match_exact(spark, d):
    return _exact(spark, d).matched.select(
        F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"),
        F.col("l.reference").alias("reference"), F.col("l.asset").alias("asset"),
        money("l.amount", "amount"), "strategy",
    )


@query(
    "unmatched_ledger",
    with_inputs(SIDES, EXACT + """SELECT ord, reference, asset, CAST(amount AS DECIMAL(38,8)) AS amount,
  counterparty, epoch_us(ts) AS ts_us, 'no_external' AS reason FROM open_l"""),
)
def unmatched_ledger(spark, d):
    return _exact(spark, d).unmatched_ledger.select(
        "ord", "reference", "asset", money("amount"), "counterparty", us("ts"), "reason"
    )


@query(
    "unmatched_external",
    with_inputs(SIDES, EXACT + """SELECT ord, external_event_id, source, asset, reference,
  CAST(amount AS DECIMAL(38,8)) AS amount, counterparty, epoch_us(ts) AS ts_us, 'no_ledger' AS reason FROM open_e"""),
)
def unmatched_external(spark, d):
    return _exact(spark, d).unmatched_external.select(
        "ord", "external_event_id", "source", "asset", "reference", money("amount"),
        "counterparty", us("ts"), "reason",
    )


@query(
    "duplicates",
    with_inputs(SIDES, EXACT + """SELECT ord, external_event_id, source, asset, reference,
  CAST(amount AS DECIMAL(38,8)) AS amount FROM dup"""),
)
def duplicates(spark, d):
    return mt.find_duplicates(view(spark, d, "fx_external")).select(
        "ord", "external_event_id", "source", "asset", "reference", money("amount")
    )


FUZZY = """,
lr AS (SELECT *, row_number() OVER (PARTITION BY asset, amount ORDER BY ord) AS rn FROM fx_fuzzy_ledger),
r AS (
  SELECT DISTINCT asset, amount, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used,
    CAST(NULL AS BIGINT) AS l_ord, CAST(NULL AS BIGINT) AS e_ord, CAST(NULL AS BIGINT) AS delta_us FROM lr
  UNION ALL
  SELECT asset, amount, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, l_ord, pick,
    coalesce(list_min([c.d FOR c IN cands IF c.d IS NOT NULL AND (first_unknown IS NULL OR c.o < first_unknown)]), 0)
  FROM (SELECT *, coalesce(first_unknown, list_min([c FOR c IN cands]).o) AS pick
    FROM (SELECT *, list_min([c.o FOR c IN cands IF c.d IS NULL]) AS first_unknown
      FROM (SELECT r.asset, r.amount, lr.rn AS k, r.used, lr.ord AS l_ord,
              coalesce(list({'d': abs(epoch_us(lr.ts) - epoch_us(e.ts)), 'o': e.ord}) FILTER (WHERE e.ord IS NOT NULL), []) AS cands
            FROM r JOIN lr ON lr.asset = r.asset AND lr.amount = r.amount AND lr.rn = r.k + 1
            LEFT JOIN fx_fuzzy_external e ON e.asset = r.asset AND coalesce(e.amount, 0) = r.amount
              AND NOT list_contains(r.used, e.ord)
              AND (lr.ts IS NULL OR e.ts IS NULL OR abs(epoch_us(lr.ts) - epoch_us(e.ts)) <= CAST(@TOLERANCE AS BIGINT) * 1000000)
            GROUP BY ALL) a) b) c),
fuzzy AS (SELECT l_ord, e_ord, delta_us FROM r WHERE e_ord IS NOT NULL)
""".replace("@TOLERANCE", str(FUZZY_TOLERANCE))

_FUZZY_SIDES = ["fx_fuzzy_ledger", "fx_fuzzy_external"]


def _fuzzy(spark, d):
    blank = F.lit(None).cast("string")
    ledger = view(spark, d, "fx_fuzzy_ledger").select(
        "ord", F.lit("").alias("reference"), "asset", "amount", blank.alias("counterparty"), "ts"
    )
    external = view(spark, d, "fx_fuzzy_external").select(
        "ord", F.col("ord").cast("string").alias("external_event_id"), F.lit(RUN_SOURCE).alias("source"),
        "asset", blank.alias("reference"), "amount", blank.alias("counterparty"), "ts",
    )
    return match_fuzzy(ledger, external, FUZZY_TOLERANCE)


@query(
    "match_fuzzy",
    with_inputs(_FUZZY_SIDES, FUZZY + "SELECT l_ord, e_ord, delta_us FROM fuzzy", recursive=True),
)
def match_fuzzy_query(spark, d):
    return _fuzzy(spark, d).matched.select(
        F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"),
        (F.col("delta_seconds") * 1_000_000).cast("bigint").alias("delta_us"),
    )


@query(
    "balance_rollforward",
    with_inputs(SIDES, ROLL + """SELECT asset, source, CAST(0 AS DECIMAL(38,8)) AS opening,
  CAST(net_flow AS DECIMAL(38,8)) AS net_flow, CAST(expected AS DECIMAL(38,8)) AS expected_closing,
  CAST(net_flow AS DECIMAL(38,8)) AS actual_closing, CAST(net_flow - expected AS DECIMAL(38,8)) AS delta,
  net_flow = expected AS matched FROM roll"""),
)
def balance_rollforward(spark, d):
    return mt.roll_forward(*_sides(spark, d)).select(
        "asset", "source",
        *[money(c) for c in ("opening", "net_flow", "expected_closing", "actual_closing", "delta")],
        "matched",
    )


@query(
    "rollforward_unmatched",
    with_inputs(SIDES, """SELECT ord, external_event_id, source, asset, reference, 'no_ledger' AS reason
  FROM fx_external WHERE amount IS NULL"""),
)
def rollforward_unmatched(spark, d):
    return mt.match_balances(*_sides(spark, d)).unmatched_external.select(
        "ord", "external_event_id", "source", "asset", "reference", "reason"
    )


@query(
    "strategy_selection",
    with_inputs(["fx_external", "fx_rules"], """,
first_rule AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY asset NULLS LAST) AS rn FROM fx_rules) t WHERE rn = 1)
SELECT s.source, CASE WHEN f.match_strategy IN ('EXACT', 'FUZZY', 'BALANCE_ROLLFORWARD') THEN f.match_strategy ELSE 'EXACT' END AS strategy
FROM (SELECT DISTINCT source FROM fx_external) s LEFT JOIN first_rule f ON s.source = f.source"""),
)
def strategy_selection(spark, d):
    return rl.strategy_per_source(view(spark, d, "fx_external"), view(spark, d, "fx_rules"))


_EOD = """WITH lr AS (SELECT o_orderkey AS ord, concat('R', o_orderkey) AS reference, concat('A', o_orderkey % 3) AS asset,
  coalesce(CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(38,18)), 0) AS amount FROM orders),
er AS (SELECT o_orderkey AS ord, concat('R', o_orderkey) AS reference, concat('A', o_orderkey % 3) AS asset,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(38,18)) AS amount FROM orders)
SELECT l.ord AS l_ord, e.ord AS e_ord, CAST(l.amount AS DECIMAL(38,8)) AS amount
FROM lr l JOIN er e ON l.reference = e.reference AND l.asset = e.asset AND l.amount = e.amount"""


@query("eod_match", _EOD)
def eod_match(spark, d):
    orders = table(spark, d, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    shared = [
        key.alias("ord"),
        F.concat(F.lit("R"), key).alias("reference"),
        F.concat(F.lit("A"), key % 3).alias("asset"),
    ]
    ledger = orders.select(*shared, F.when(key % 9 != 0, price).alias("amount"))
    external = orders.select(
        *shared, F.when(key % 9 == 0, F.lit(0.0)).when(key % 4 == 0, price + 1).otherwise(price).alias("amount")
    )
    return run.match_batch(ledger, external).matched.select(
        F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"), money("l.amount", "amount")
    )


@query(
    "key_overlap",
    with_inputs(SIDES, """, a AS (SELECT reference, asset, count(*) AS n FROM fx_ledger GROUP BY ALL),
b AS (SELECT reference, asset, count(*) AS n FROM fx_external GROUP BY ALL)
SELECT a.reference, a.asset, a.n AS ledger_rows, b.n AS external_rows FROM a JOIN b ON a.reference = b.reference AND a.asset = b.asset"""),
)
def key_overlap(spark, d):
    return mt.key_overlap(*_sides(spark, d))


@query(
    "classify_timing",
    with_inputs(SIDES, """SELECT e.ord, CASE WHEN l.ts IS NULL OR e.ts IS NULL OR abs(epoch_us(l.ts) - epoch_us(e.ts)) <= 300000000
  THEN 'TIMING' ELSE 'REAL' END AS classification
FROM fx_external e LEFT JOIN fx_ledger l ON e.reference = l.reference"""),
)
def classify_timing_query(spark, d):
    ledger, external = _sides(spark, d)
    known = ledger.select("reference", F.col("ts").alias("ledger_ts"))
    return external.join(known, "reference", "left").select(
        "ord", classify_timing("ledger_ts", "ts", TOLERANCE).alias("classification")
    )


@query(
    "classify_amount",
    with_inputs(_FUZZY_SIDES, FUZZY + """SELECT l_ord, e_ord, CASE WHEN delta_us <= 3600000000 THEN 'TIMING' ELSE 'REAL' END AS classification
FROM fuzzy""", recursive=True),
)
def classify_amount_query(spark, d):
    return _fuzzy(spark, d).matched.select(
        F.col("l.ord").alias("l_ord"), F.col("e.ord").alias("e_ord"),
        classify_amount("delta_seconds", 3600).alias("classification"),
    )


@query("breaks_timing_gap", with_inputs(SIDES, EXACT + _breaks_sql(["ledger"])))
def breaks_timing_gap(spark, d):
    return break_out(br.timing_gap_breaks(_exact(spark, d), *_detect_args()))


@query("breaks_missing_entry", with_inputs(SIDES, EXACT + _breaks_sql(["external"])))
def breaks_missing_entry(spark, d):
    return break_out(br.missing_entry_breaks(_exact(spark, d), *_detect_args()))


@query("breaks_amount_mismatch", with_inputs(SIDES, ROLL + _breaks_sql(["balance"])))
def breaks_amount_mismatch(spark, d):
    balances = mt.roll_forward(*_sides(spark, d))
    return break_out(br.balance_breaks(balances, *_detect_args()[:3]))


@query("breaks_duplicate", with_inputs(SIDES, EXACT + _breaks_sql(["duplicate"])))
def breaks_duplicate(spark, d):
    found = mt.find_duplicates(view(spark, d, "fx_external"))
    return break_out(br.duplicate_breaks(found, F.lit(RUN_ID), br.as_column(NOW)))


@query("detect_breaks", with_inputs(SIDES, EXACT + _breaks_sql(["ledger", "external", "duplicate"])))
def detect_breaks(spark, d):
    return break_out(br.detect_breaks(_exact(spark, d), RUN_ID, RUN_SOURCE, NOW, TOLERANCE))


@query(
    "break_age",
    with_inputs(["fx_breaks"], f"SELECT b.break_id, {age_sql()} AS age_seconds FROM fx_breaks b"),
)
def break_age(spark, d):
    at = br.as_column(NOW)
    return view(spark, d, "fx_breaks").select(
        "break_id", age_seconds("detected_at", at).alias("age_seconds")
    )


def recon(spark, d) -> run.Run:
    return run.reconcile(
        *_sides(spark, d), run_id=RUN_ID, source=RUN_SOURCE, tolerance_seconds=TOLERANCE, started_at=NOW
    )


@query(
    "recon_run",
    with_inputs(SIDES, EXACT + f"""SELECT '{RUN_ID}' AS run_id, '{RUN_SOURCE}' AS source, 'daily' AS scope, 'COMPLETED' AS status,
  (SELECT count(*) FROM exact) AS matched_count,
  (SELECT count(*) FROM open_l) + (SELECT count(*) FROM open_e) AS unmatched_count,
  (SELECT count(*) FROM open_l) + (SELECT count(*) FROM open_e) + (SELECT count(*) FROM dup) AS breaks_count,
  epoch_us({NOW_SQL}) AS started_us"""),
)
def recon_run(spark, d):
    return recon(spark, d).record.select(
        "run_id", "source", "scope", "status", "matched_count", "unmatched_count", "breaks_count",
        us("started_at", "started_us"),
    )


@query(
    "recon_run_balances",
    with_inputs(SIDES, ROLL + f"""SELECT '{RUN_ID}' AS run_id, 'COMPLETED' AS status,
  (SELECT count(*) FROM roll WHERE net_flow = expected) AS matched_count,
  (SELECT count(*) FROM fx_external WHERE amount IS NULL) AS unmatched_count,
  (SELECT count(*) FROM fx_external WHERE amount IS NULL) + (SELECT count(*) FROM roll WHERE net_flow <> expected) AS breaks_count"""),
)
def recon_run_balances(spark, d):
    done = run.reconcile(
        *_sides(spark, d), run_id=RUN_ID, source=RUN_SOURCE, strategy="BALANCE_ROLLFORWARD", started_at=NOW
    )
    return done.record.select("run_id", "status", "matched_count", "unmatched_count", "breaks_count")


LOOKBACK_START = datetime(1998, 6, 1, tzinfo=timezone.utc)


@query(
    "ledger_lookback",
    with_inputs(["fx_ledger"], """SELECT ord, reference, asset, CAST(amount AS DECIMAL(38,8)) AS amount
FROM fx_ledger WHERE ts >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL '300' SECOND"""),
)
def ledger_lookback(spark, d):
    recent = run.ledger_lookback(view(spark, d, "fx_ledger"), LOOKBACK_START, TOLERANCE)
    return recent.select("ord", "reference", "asset", report_money("amount").alias("amount"))
