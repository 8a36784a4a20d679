"""Inputs of matching runs, derived from the benchmark tables.

The texts run unchanged on Spark and on the engine that checks the results.
`with_inputs` puts the views a statement needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ASSET4 = "CASE {k} % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'BTC' ELSE 'ETH' END"
_ASSET3 = "CASE {k} % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'BTC' END"
_SOURCE = (
    "CASE CAST(floor({k} / 4) AS BIGINT) % 4 WHEN 0 THEN 'RAILS' WHEN 1 THEN 'EXCHANGES'"
    " WHEN 2 THEN 'ONCHAIN' ELSE 'CUSTODY' END"
)
_ORDERS = (
    "SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,"
    " CAST(o_orderdate AS TIMESTAMP) AS d FROM orders"
)

# name -> (tables and views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: tuple[str, ...], text: str) -> None:
    VIEWS[name] = (needs, text)


# Discrepancies planted by k % 20: 0 no event, 1 amount + 1, 2 no event
# counterparty, 3 no event reference, 4 no event amount, 5 no event time,
# 6 '' against null counterparty, 7 + 120 s, 8 + 900 s, 9 delivered twice,
# 10 two events, 11 no ledger row, the rest identical.
_view(
    "fx_ledger",
    ("orders",),
    f"""SELECT k AS ord, concat('R', k) AS reference, {_ASSET4.format(k="k")} AS asset,
  CAST(amt AS DECIMAL(38,18)) AS amount,
  CASE WHEN k % 20 = 6 THEN '' ELSE concat('C', cust) END AS counterparty, d AS ts
FROM ({_ORDERS}) o WHERE k % 20 <> 11""",
)
_view(
    "fx_external_raw",
    ("orders",),
    f"""SELECT k * 10 + copy AS ord,
  CASE WHEN copy = 1 AND k % 20 = 9 THEN concat('E', k, '-0') ELSE concat('E', k, '-', copy) END AS external_event_id,
  {_SOURCE.format(k="k")} AS source, {_ASSET4.format(k="k")} AS asset,
  CASE WHEN k % 20 = 3 THEN NULL ELSE concat('R', k) END AS reference,
  CASE WHEN k % 20 = 4 THEN NULL WHEN k % 20 = 1 THEN CAST(amt + 1 AS DECIMAL(38,18)) ELSE CAST(amt AS DECIMAL(38,18)) END AS amount,
  CASE WHEN k % 20 IN (2, 6) THEN NULL ELSE concat('C', cust) END AS counterparty,
  CASE WHEN k % 20 = 5 THEN NULL WHEN k % 20 = 7 THEN d + INTERVAL '120' SECOND WHEN k % 20 = 8 THEN d + INTERVAL '900' SECOND ELSE d END AS ts
FROM (SELECT *, 0 AS copy FROM ({_ORDERS}) o0 WHERE k % 20 <> 0
  UNION ALL SELECT *, 1 AS copy FROM ({_ORDERS}) o1 WHERE k % 20 IN (9, 10)) o""",
)
_view(
    "fx_external",
    ("fx_external_raw",),
    """SELECT ord, external_event_id, source, asset, reference, amount, counterparty, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_event_id ORDER BY ord) AS rn FROM fx_external_raw) t WHERE rn = 1""",
)

# Heavy contention for the same amounts, and unknown times on both sides.
_view(
    "fx_fuzzy_ledger",
    ("events",),
    """SELECT event_id AS ord, CASE WHEN event_id % 10 = 0 THEN concat(event_type, ' inside') ELSE event_type END AS asset,
  CAST(round(value / 10) AS DECIMAL(38,18)) AS amount, CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS ts
FROM events""",
)
_view(
    "fx_fuzzy_external",
    ("events",),
    """SELECT event_id AS ord, CASE WHEN event_id % 10 = 1 THEN concat(event_type, ' outside') ELSE event_type END AS asset,
  CAST(round(value / 10) AS DECIMAL(38,18)) AS amount, CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + (event_id * 7919 % 30000 - 15000) * INTERVAL '1' SECOND END AS ts
FROM events""",
)

# Break state and what arrives later.
_view(
    "fx_breaks",
    ("orders",),
    f"""SELECT concat('B', k) AS break_id, concat('run', k % 5) AS run_id,
  CASE k % 4 WHEN 0 THEN 'TIMING_GAP' WHEN 1 THEN 'MISSING_ENTRY' WHEN 2 THEN 'AMOUNT_MISMATCH' ELSE 'DUPLICATE' END AS type,
  CASE WHEN k % 4 = 0 THEN 'TIMING' ELSE 'REAL' END AS classification,
  {_SOURCE.format(k="k")} AS source, {_ASSET3.format(k="k")} AS asset,
  CASE WHEN k % 4 = 2 THEN NULL ELSE concat('R', k) END AS reference,
  CASE WHEN k % 4 IN (0, 2) THEN CAST(amt AS DECIMAL(28,8)) END AS internal_amount,
  CASE WHEN k % 4 IN (1, 2, 3) THEN CAST(amt + 1 AS DECIMAL(28,8)) END AS external_amount,
  CASE WHEN k % 10 = 7 THEN 'RESOLVED' WHEN k % 10 = 8 THEN 'ESCALATED' ELSE 'OPEN' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + (k * 37 % 10800) * INTERVAL '1' SECOND AS detected_at,
  CASE WHEN k % 10 = 7 THEN TIMESTAMP '2024-01-01 03:00:00' END AS resolved_at,
  CAST(0 AS BIGINT) AS age_seconds
FROM ({_ORDERS}) o""",
)
_view(
    "fx_new_events",
    ("orders",),
    f"""SELECT concat('N', k) AS external_event_id, k AS ord,
  {_SOURCE.format(k="k")} AS source, {_ASSET3.format(k="k")} AS asset,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('R', k) END AS reference,
  CASE WHEN k % 11 = 0 THEN CAST(amt + 1 AS DECIMAL(38,18)) ELSE CAST(amt AS DECIMAL(38,18)) END AS amount,
  CAST(NULL AS VARCHAR(8)) AS counterparty,
  CASE WHEN k % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + (k * 37 % 10800 + k % 600) * INTERVAL '1' SECOND END AS ts
FROM ({_ORDERS}) o""",
)
# Operator commands: some on unknown breaks.
_view(
    "fx_commands",
    ("orders",),
    """SELECT CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 30 = 5 THEN concat('unknown', o_orderkey) ELSE concat('B', o_orderkey) END AS break_id,
  concat('operator', o_custkey % 7) AS actor,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('checked ', o_orderkey) END AS note
FROM orders""",
)
_view(
    "fx_resolutions",
    ("orders",),
    """SELECT concat('B', CAST(floor(o_orderkey / 3) AS BIGINT)) AS break_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'MANUAL' ELSE 'AUTO' END AS type, concat('operator', o_custkey % 7) AS actor,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('note ', o_orderkey) END AS note,
  TIMESTAMP '2024-01-02 00:00:00' + (o_orderkey % 86400) * INTERVAL '1' SECOND AS created_at
FROM orders""",
)
# One rule per (source, asset); CUSTODY has no rule for all assets.
_view(
    "fx_rules",
    ("supplier",),
    """SELECT CASE s % 4 WHEN 0 THEN 'RAILS' WHEN 1 THEN 'EXCHANGES' WHEN 2 THEN 'ONCHAIN' ELSE 'CUSTODY' END AS source,
  CASE CAST(floor(s / 4) AS BIGINT) WHEN 0 THEN CASE WHEN s = 3 THEN 'AST0' END WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'BTC' ELSE concat('AST', CAST(floor(s / 4) AS BIGINT)) END AS asset,
  CASE s % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'FUZZY' ELSE 'BALANCE_ROLLFORWARD' END AS match_strategy,
  CAST(60 * (s % 7 + 1) AS BIGINT) AS tolerance_seconds, CAST(15 * (s % 8 + 1) AS BIGINT) AS escalation_age_minutes,
  s % 5 <> 0 AS auto_resolve_timing, concat('{"origin":', s, '}') AS config
FROM (SELECT s_suppkey AS s FROM supplier) t""",
)
_view(
    "fx_runs",
    ("customer",),
    """SELECT concat('run', k) AS run_id,
  CASE k % 4 WHEN 0 THEN 'RAILS' WHEN 1 THEN 'EXCHANGES' WHEN 2 THEN 'ONCHAIN' ELSE 'CUSTODY' END AS source,
  'daily' AS scope, 'COMPLETED' AS status, k * 3 AS matched_count, k * 2 AS unmatched_count, k AS breaks_count,
  TIMESTAMP '2024-01-01 00:00:00' + k * INTERVAL '1' MINUTE AS started_at,
  TIMESTAMP '2024-01-01 00:00:30' + k * INTERVAL '1' MINUTE AS completed_at
FROM (SELECT c_custkey AS k FROM customer) c""",
)

# Stream records by k % 50: 0 not JSON, 1 amount not a number, 2 posting id
# instead of event id, 3 unknown topic, 4 no id, 5 repeats an earlier id.
_view(
    "fx_messages",
    ("events",),
    """SELECT CASE WHEN k % 50 = 3 THEN 'unknown.topic' WHEN k % 5 = 0 THEN 'ledger.events.v1' WHEN k % 5 = 1 THEN 'rail.events.v1' WHEN k % 5 = 2 THEN 'exchange.events.v1'
    WHEN k % 5 = 3 THEN 'blockchain.events.v1' ELSE 'custody.events.v1' END AS topic,
  CAST(k % 4 AS INT) AS part, k AS pos, concat('u', u) AS msg_key,
  CASE WHEN k % 50 = 0 THEN 'not json'
    WHEN k % 50 = 1 THEN concat('{"external_event_id":"E', k, '","asset":"USD","amount":"abc"}')
    WHEN k % 50 = 2 THEN concat('{"posting_id":"P', k, '","asset":"USD","amount":"1.50"}')
    WHEN k % 50 = 4 THEN '{"asset":"USD","amount":"1"}'
    ELSE concat('{"external_event_id":"E', CASE WHEN k % 50 = 5 THEN k - 10 ELSE k END, '","asset":"', t, '","amount":"', CAST(v AS DECIMAL(18,2)), '","reference":"R', k, '","timestamp":"2024-01-01T00:00:00Z"}') END AS body
FROM (SELECT event_id AS k, user_id AS u, event_type AS t, value AS v FROM events) e""",
)

# Balance snapshots reported by each source: some are off, some keys have one only.
_view(
    "fx_snapshots",
    ("orders",),
    f"""SELECT {_SOURCE.format(k="k")} AS source, concat('ACC', cust) AS asset,
  CAST(amt + k % 3 AS DECIMAL(38,18)) AS balance, d + (k % 86400) * INTERVAL '1' SECOND AS ts, k AS ord
FROM ({_ORDERS}) o""",
)
_view(
    "fx_flows",
    ("orders",),
    f"""SELECT k AS ord, {_SOURCE.format(k="k")} AS source, concat('ACC', cust) AS asset,
  CAST(CASE WHEN k % 2 = 0 THEN amt ELSE -amt END AS DECIMAL(38,18)) AS amount, d + (k * 31 % 86400) * INTERVAL '1' SECOND AS ts
FROM ({_ORDERS}) o""",
)


# What arrives in four micro-batches: rows of both sides by a time of arrival
# that may be days after their own, and changes of breaks in a fixed order.
_view(
    "fx_arriving",
    ("fx_ledger", "fx_external_raw"),
    """SELECT *, CASE WHEN arrive < TIMESTAMP '1993-09-01 00:00:00' THEN 0 WHEN arrive < TIMESTAMP '1995-05-01 00:00:00' THEN 1
  WHEN arrive < TIMESTAMP '1997-01-01 00:00:00' THEN 2 ELSE 3 END AS batch FROM (
  SELECT 0 AS side, ord, CAST(NULL AS VARCHAR(8)) AS external_event_id, CAST(NULL AS VARCHAR(8)) AS source, asset, reference, amount, counterparty, ts, ts AS arrive FROM fx_ledger
  UNION ALL SELECT 1, ord, external_event_id, source, asset, reference, amount, counterparty, ts,
    coalesce(ts, TIMESTAMP '1992-01-01 00:00:00' + ord % 2400 * INTERVAL '1' DAY)
    + CASE WHEN floor(ord / 10) % 20 = 12 THEN 40 WHEN floor(ord / 10) % 20 = 13 THEN 10 ELSE ord % 3 END * INTERVAL '1' DAY FROM fx_external_raw) a""",
)
_view(
    "fx_loop_breaks",
    ("fx_breaks",),
    """SELECT b.*, k % 3 AS batch, k % 3 * 10000000000000 + k AS ord FROM (SELECT *, CAST(substring(break_id, 2) AS BIGINT) AS k FROM fx_breaks) b
UNION ALL SELECT concat(break_id, '-again') AS break_id, run_id, type, classification, source, asset, reference, internal_amount, external_amount,
  'OPEN' AS status, detected_at, CAST(NULL AS TIMESTAMP) AS resolved_at, age_seconds, k, 3 AS batch, 3 * 10000000000000 + k AS ord
FROM (SELECT *, CAST(substring(break_id, 2) AS BIGINT) AS k FROM fx_breaks) a WHERE k % 9 = 0""",
)
_view(
    "fx_loop_events",
    ("fx_new_events",),
    """SELECT external_event_id, source, asset, reference, amount, counterparty, ts, ord % 3 + ord % 2 AS batch,
  (ord % 3 + ord % 2) * 10000000000000 + 1000000000000 + 2 * ord AS ord FROM fx_new_events""",
)
_view(
    "fx_loop_commands",
    ("orders",),
    """SELECT concat('B', k) AS break_id, action, concat('operator', k % 7) AS actor, concat('checked ', k) AS note, batch,
  batch * 10000000000000 + 1000000000000 + 2 * k + 1 AS ord FROM (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'resolve' ELSE 'escalate' END AS action, o_orderkey % 4 AS batch FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'escalate', 3 FROM orders WHERE o_orderkey % 10 = 0) c""",
)


def _needed(name: str, seen: list[str]) -> list[str]:
    for need in VIEWS[name][0]:
        if need in VIEWS and need not in seen:
            _needed(need, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_inputs(names: list[str], body: str, recursive: bool = False) -> str:
    """`WITH` the named views (and theirs) in front of `body`.

    `body` may itself start with more views: `, x AS (...) SELECT ...`.
    """
    order: list[str] = []
    for name in names:
        _needed(name, order)
    views = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt out to all of them.

    For small files in front of much work per row; a large input has more
    splits than cores and stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str, busy: bool = False) -> DataFrame:
    """A derived input as a DataFrame; `busy` if much work per row follows."""
    order = _needed(name, [])
    for base in {need for v in order for need in VIEWS[v][0] if need not in VIEWS}:
        rows = table(spark, sf_dir, base)
        (spread(rows) if busy else rows).createOrReplaceTempView(base)
    return spark.sql(with_inputs([name], f"SELECT * FROM {name}"))
