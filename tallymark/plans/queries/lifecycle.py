"""Ageing, escalation, resolution, rules and the events they emit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import events as ev
from tallymark.operators import lifecycle as lc
from tallymark.operators import rules as rl
from tallymark.operators.breaks import as_column
from tallymark.plans.fixtures import view, with_inputs
from tallymark.plans.registry import (
    NOW, NOW_SQL, TOLERANCE, age_sql, break_out, query, sql_break_out, us,
)

AGED = f"(SELECT b.*, {age_sql()} AS new_age FROM fx_breaks b)"
ISO_Z = "strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"

# Earliest event that closes each open timing break.
CLOSED = f""",
closed AS (SELECT break_id, external_event_id, e_ref FROM (
  SELECT b.break_id, e.external_event_id, e.reference AS e_ref, row_number() OVER (PARTITION BY b.break_id ORDER BY e.ord) AS rn
  FROM fx_breaks b JOIN fx_new_events e ON b.source = e.source AND b.asset = e.asset AND coalesce(b.internal_amount, 0) = coalesce(e.amount, 0)
  WHERE b.classification = 'TIMING' AND b.status = 'OPEN' AND (e.reference IS NULL OR b.reference = e.reference)
  AND (e.ts IS NULL OR abs(epoch_us(b.detected_at) - epoch_us(e.ts)) <= {TOLERANCE}000000)) x WHERE rn = 1)
"""


def _breaks(spark, d):
    return view(spark, d, "fx_breaks")


def _commands(spark, d):
    rows = view(spark, d, "fx_commands")
    return rows.withColumn("ord", F.regexp_extract("break_id", r"(\d+)$", 1).cast("bigint"))


@query(
    "update_ages",
    with_inputs(["fx_breaks"], f"""SELECT {sql_break_out()}, new_age AS age_seconds FROM {AGED} b
WHERE status = 'OPEN' AND new_age <> age_seconds"""),
)
def update_ages(spark, d):
    return break_out(lc.update_ages(_breaks(spark, d), NOW))


@query(
    "escalate_stale",
    with_inputs(["fx_breaks"], f"""SELECT break_id, 'ESCALATED' AS status, new_age AS age_seconds, 'OPEN' AS before_status,
  age_seconds AS before_age, 'system' AS actor FROM {AGED} b WHERE status = 'OPEN' AND new_age >= 3600"""),
)
def escalate_stale(spark, d):
    return lc.escalate_stale(_breaks(spark, d), NOW, 60).select(
        "break_id", "status", "age_seconds", "before_status", "before_age", "actor"
    )


@query(
    "age_and_escalate",
    with_inputs(["fx_breaks"], f"""SELECT {sql_break_out()}, new_age AS age_seconds FROM (
  SELECT * REPLACE (CASE WHEN status = 'OPEN' AND new_age >= 3600 THEN 'ESCALATED' ELSE status END AS status,
    CASE WHEN status = 'OPEN' THEN new_age ELSE age_seconds END AS new_age) FROM {AGED} a) b"""),
)
def age_and_escalate(spark, d):
    """The full state after the cycle."""
    breaks = _breaks(spark, d)
    return break_out(lc.apply_to(breaks, lc.age_and_escalate(breaks, NOW, 60)))


_COMMANDED = "fx_commands c JOIN fx_breaks b ON b.break_id = c.break_id"


@query(
    "manual_escalate",
    with_inputs(["fx_breaks", "fx_commands"], f"""SELECT b.break_id, 'ESCALATED' AS status, {age_sql()} AS age_seconds,
  b.status AS before_status, c.actor, c.note, 'MANUAL' AS resolution_type FROM {_COMMANDED}"""),
)
def manual_escalate(spark, d):
    return lc.escalate_manually(_breaks(spark, d), _commands(spark, d), NOW).select(
        "break_id", "status", "age_seconds", "before_status", "actor", "note", "resolution_type"
    )


@query(
    "manual_resolve",
    with_inputs(["fx_breaks", "fx_commands"], f"""SELECT b.break_id, 'RESOLVED' AS status, b.age_seconds,
  epoch_us(coalesce(b.resolved_at, {NOW_SQL})) AS resolved_us, b.status AS before_status, c.actor, c.note,
  'MANUAL' AS resolution_type FROM {_COMMANDED}"""),
)
def manual_resolve(spark, d):
    return lc.resolve_manually(_breaks(spark, d), _commands(spark, d), NOW).select(
        "break_id", "status", "age_seconds", us("resolved_at", "resolved_us"), "before_status",
        "actor", "note", "resolution_type",
    )


@query(
    "open_timing_breaks",
    with_inputs(["fx_breaks", "fx_new_events"], """, o AS (SELECT * FROM fx_breaks WHERE classification = 'TIMING' AND status = 'OPEN'),
by_ref AS (SELECT source, asset, reference, count(*) AS n FROM o WHERE reference IS NOT NULL GROUP BY ALL),
overall AS (SELECT source, asset, count(*) AS n FROM o GROUP BY ALL)
SELECT e.external_event_id, e.source, e.asset, e.reference,
  CAST(coalesce(CASE WHEN e.reference IS NULL THEN a.n ELSE r.n END, 0) AS BIGINT) AS open_breaks
FROM fx_new_events e LEFT JOIN by_ref r ON e.source = r.source AND e.asset = r.asset AND e.reference = r.reference
LEFT JOIN overall a ON e.source = a.source AND e.asset = a.asset"""),
)
def open_timing_breaks(spark, d):
    return lc.count_open_timing_breaks(_breaks(spark, d), view(spark, d, "fx_new_events")).select(
        "external_event_id", "source", "asset", "reference", "open_breaks"
    )


_RESOLVED = f"""SELECT b.break_id, 'RESOLVED' AS status, CAST(0 AS BIGINT) AS age_seconds,
  epoch_us({NOW_SQL}) AS resolved_us, c.external_event_id,
  concat('auto-resolved by external event for ', b.source, '/', b.asset, '/', coalesce(c.e_ref, 'None')) AS note,
  'AUTO' AS resolution_type FROM closed c JOIN fx_breaks b ON b.break_id = c.break_id"""


def _auto(breaks, spark, d):
    return lc.auto_resolve(breaks, view(spark, d, "fx_new_events"), NOW, TOLERANCE).select(
        "break_id", "status", "age_seconds", us("resolved_at", "resolved_us"),
        "external_event_id", "note", "resolution_type",
    )


@query("auto_resolve", with_inputs(["fx_breaks", "fx_new_events"], CLOSED + _RESOLVED))
def auto_resolve(spark, d):
    return _auto(_breaks(spark, d), spark, d)


@query(
    "status_update",
    with_inputs(["fx_breaks", "fx_commands"], f"""SELECT b.break_id,
  CASE WHEN length(c.actor) % 2 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE WHEN c.note IS NULL THEN b.age_seconds ELSE 77 END AS age_seconds,
  epoch_us(coalesce(b.resolved_at, CASE WHEN length(c.actor) % 2 = 0 THEN {NOW_SQL} END)) AS resolved_us
FROM {_COMMANDED}"""),
)
def status_update(spark, d):
    changes = _commands(spark, d).select(
        "break_id", F.lit(0).alias("ord"),
        F.when(F.length("actor") % 2 == 0, F.lit("CLOSED")).otherwise(F.lit("OPEN")).alias("new_status"),
        F.when(F.col("note").isNotNull(), F.lit(77).cast("bigint")).alias("new_age"),
    )
    return lc.set_status(_breaks(spark, d), changes, NOW).select(
        "break_id", "status", "age_seconds", us("resolved_at", "resolved_us")
    )


@query(
    "append_resolution",
    with_inputs(["fx_breaks", "fx_resolutions"], """SELECT r.break_id, r.type, r.actor, r.note, epoch_us(r.created_at) AS created_us
FROM fx_resolutions r WHERE r.break_id IN (SELECT break_id FROM fx_breaks)"""),
)
def append_resolution(spark, d):
    return lc.append_resolutions(_breaks(spark, d), view(spark, d, "fx_resolutions")).select(
        "break_id", "type", "actor", "note", us("created_at", "created_us")
    )


@query(
    "current_state",
    with_inputs(["fx_breaks", "fx_commands"], f"""SELECT b.break_id,
  CASE WHEN c.break_id IS NOT NULL THEN 'RESOLVED' WHEN b.status = 'OPEN' AND new_age >= 3600 THEN 'ESCALATED' ELSE b.status END AS status,
  CASE WHEN b.status = 'OPEN' AND new_age >= 3600 THEN new_age ELSE b.age_seconds END AS age_seconds,
  epoch_us(coalesce(b.resolved_at, CASE WHEN c.break_id IS NOT NULL THEN {NOW_SQL} END)) AS resolved_us
FROM {AGED} b LEFT JOIN fx_commands c ON b.break_id = c.break_id"""),
)
def current_state(spark, d):
    """State from a log of two steps: stale breaks escalate, then operators resolve some."""
    breaks = _breaks(spark, d)
    first = lc.escalate_stale(breaks, NOW, 60)
    second = lc.resolve_manually(lc.apply_to(breaks, first), _commands(spark, d), NOW)
    log = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return lc.current_state(breaks, log).select(
        "break_id", "status", "age_seconds", us("resolved_at", "resolved_us")
    )


# --- Rules ---

_KEYS = "(SELECT DISTINCT source, asset FROM fx_breaks)"


@query(
    "rules_for",
    with_inputs(["fx_breaks", "fx_rules"], f"""SELECT k.source, k.asset, r.asset AS rule_asset, r.match_strategy, r.tolerance_seconds
FROM {_KEYS} k JOIN fx_rules r ON k.source = r.source AND (r.asset = k.asset OR r.asset IS NULL)"""),
)
def rules_for(spark, d):
    keys = _breaks(spark, d).select("source", "asset").distinct()
    return rl.applicable_rules(keys, view(spark, d, "fx_rules")).select(
        "source", "asset", "rule_asset", "match_strategy", "tolerance_seconds"
    )


@query(
    "list_rules",
    with_inputs(["fx_rules"], """SELECT source, asset, match_strategy, tolerance_seconds, escalation_age_minutes,
  auto_resolve_timing, config FROM fx_rules ORDER BY source, asset NULLS LAST"""),
)
def list_rules(spark, d):
    return rl.list_rules(view(spark, d, "fx_rules"))


_CHANGES = """, changes AS (SELECT source, CASE WHEN tolerance_seconds = 240 THEN concat(coalesce(asset, 'ANY'), '-NEW') ELSE asset END AS asset,
  CASE WHEN tolerance_seconds = 120 THEN NULL ELSE 'EXACT' END AS match_strategy, tolerance_seconds + 1 AS tolerance_seconds,
  CAST(NULL AS BIGINT) AS escalation_age_minutes, NOT auto_resolve_timing AS auto_resolve_timing, CAST(NULL AS VARCHAR(8)) AS config
  FROM fx_rules WHERE tolerance_seconds IN (60, 120, 240))"""


@query(
    "upsert_rules",
    with_inputs(["fx_rules"], _CHANGES + """
SELECT coalesce(r.source, c.source) AS source, coalesce(r.asset, c.asset) AS asset, coalesce(c.match_strategy, r.match_strategy, 'EXACT') AS match_strategy,
  coalesce(c.tolerance_seconds, r.tolerance_seconds, 300) AS tolerance_seconds,
  coalesce(c.escalation_age_minutes, r.escalation_age_minutes, 60) AS escalation_age_minutes,
  coalesce(c.auto_resolve_timing, r.auto_resolve_timing, true) AS auto_resolve_timing, coalesce(c.config, r.config, '{}') AS config
FROM fx_rules r FULL OUTER JOIN changes c ON r.source = c.source AND r.asset IS NOT DISTINCT FROM c.asset"""),
)
def upsert_rules(spark, d):
    rules = view(spark, d, "fx_rules")
    changed = rules.where("tolerance_seconds IN (60, 120, 240)")
    renamed = F.concat(F.coalesce("asset", F.lit("ANY")), F.lit("-NEW"))
    changes = changed.select(
        "source",
        F.when(F.col("tolerance_seconds") == 240, renamed).otherwise(F.col("asset")).alias("asset"),
        F.when(F.col("tolerance_seconds") != 120, F.lit("EXACT")).alias("match_strategy"),
        (F.col("tolerance_seconds") + 1).alias("tolerance_seconds"),
        F.lit(None).cast("bigint").alias("escalation_age_minutes"),
        (~F.col("auto_resolve_timing")).alias("auto_resolve_timing"),
        F.lit(None).cast("string").alias("config"),
    )
    return rl.upsert_rules(rules, changes)


def ruled(column: str, default: str) -> str:
    """Break rows with the value of the most specific rule."""
    return f""",
ruled AS (SELECT b.*, coalesce(a.{column}, g.{column}, {default}) AS rule_value,
  CASE WHEN a.source IS NOT NULL THEN 'asset' WHEN g.source IS NOT NULL THEN 'source' ELSE 'default' END AS rule_level
  FROM fx_breaks b LEFT JOIN (SELECT * FROM fx_rules WHERE asset IS NOT NULL) a ON b.source = a.source AND b.asset = a.asset
  LEFT JOIN (SELECT * FROM fx_rules WHERE asset IS NULL) g ON b.source = g.source)
"""


@query(
    "rule_tolerance",
    with_inputs(["fx_breaks", "fx_rules"], ruled("tolerance_seconds", "300")
                + "SELECT break_id, rule_value AS tolerance_seconds, rule_level FROM ruled"),
)
def rule_tolerance(spark, d):
    return rl.with_tolerance(_breaks(spark, d), view(spark, d, "fx_rules")).select(
        "break_id", "tolerance_seconds", "rule_level"
    )


@query(
    "rule_escalation",
    with_inputs(["fx_breaks", "fx_rules"], ruled("escalation_age_minutes", "60")
                + f"""SELECT break_id, 'ESCALATED' AS status, {age_sql()} AS age_seconds FROM ruled b
WHERE status = 'OPEN' AND {age_sql()} >= rule_value * 60"""),
)
def rule_escalation(spark, d):
    rows = rl.with_escalation_age(_breaks(spark, d), view(spark, d, "fx_rules"))
    return lc.escalate_stale(rows, NOW, F.col("escalation_age_minutes")).select(
        "break_id", "status", "age_seconds"
    )


@query(
    "rule_auto_resolve",
    with_inputs(["fx_breaks", "fx_new_events", "fx_rules"], CLOSED + ruled("auto_resolve_timing", "true")
                + _RESOLVED.replace("JOIN fx_breaks b", "JOIN (SELECT * FROM ruled WHERE rule_value) b")),
)
def rule_auto_resolve(spark, d):
    rows = rl.with_auto_resolve(_breaks(spark, d), view(spark, d, "fx_rules"))
    return _auto(rows.where("auto_resolve_timing"), spark, d)


# --- Emitted events ---

_T = ISO_Z.format(t=NOW_SQL)


def _json_text(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'null' ELSE concat('\"', {expr}, '\"') END"


def _money_sql(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(28,8)) AS VARCHAR)"


_ESCALATED = f"(SELECT * FROM {AGED} x WHERE status = 'OPEN' AND new_age >= 3600) b"


@query(
    "break_alerts",
    with_inputs(["fx_breaks"], f"""SELECT 'break-alert' AS topic, break_id AS key, concat('{{"break_id":"', break_id, '","type":"', type, '","classification":"', classification,
  '","source":"', source, '","asset":"', asset, '","reference":', {_json_text("reference")}, ',"internal_amount":', {_json_text(_money_sql("internal_amount"))},
  ',"external_amount":', {_json_text(_money_sql("external_amount"))}, ',"detected_at":"', {ISO_Z.format(t="detected_at")}, '","age_seconds":', new_age,
  ',"action":"escalated","actor":"system","timestamp":"', {_T}, '"}}') AS value FROM {_ESCALATED}"""),
)
def break_alerts(spark, d):
    return ev.as_messages(lc.alerts_of(lc.escalate_stale(_breaks(spark, d), NOW, 60)))


def _audit_sql(action: str, actor: str, before: str, after: str) -> str:
    """Canonical JSON of an audit; before/after are SQL texts of JSON objects."""
    return (
        f"concat('{{\"action\":\"', {action}, '\",\"actor\":\"', {actor}, '\",\"after\":', {after},"
        f" ',\"before\":', {before}, ',\"break_id\":\"', break_id, '\",\"timestamp\":\"', {_T}, '\"}}')"
    )


_STATUS = "concat('{{\"status\":\"', {s}, '\"}}')"
_AGE_STATUS = "concat('{{\"age_seconds\":', {a}, ',\"status\":\"', {s}, '\"}}')"

AUDITS = f""",
audits AS (
  SELECT break_id, 'detected' AS action, 'system' AS actor, NULL AS before_status, NULL AS after_status,
    {_audit_sql("'detected'", "'system'", "'{}'", "concat('{\"classification\":\"', classification, '\",\"run_id\":\"', run_id, '\"}')")} AS payload FROM fx_breaks
  UNION ALL SELECT break_id, 'escalated', 'system', 'OPEN', 'ESCALATED',
    {_audit_sql("'escalated'", "'system'", _AGE_STATUS.format(a="age_seconds", s="'OPEN'"), _AGE_STATUS.format(a="new_age", s="'ESCALATED'"))} FROM {_ESCALATED}
  UNION ALL SELECT b.break_id, 'manually-resolved', c.actor, b.status, 'RESOLVED',
    {_audit_sql("'manually-resolved'", "c.actor", _STATUS.format(s="b.status"), _STATUS.format(s="'RESOLVED'")).replace("', break_id,", "', b.break_id,")} FROM {_COMMANDED})
"""


def _audits(spark, d):
    """Audits of three kinds of change on the same state."""
    breaks = _breaks(spark, d)
    detected = ev.detected_audits(breaks, as_column(NOW))
    escalated = lc.audits_of(lc.escalate_stale(breaks, NOW, 60))
    resolved = lc.audits_of(lc.resolve_manually(breaks, _commands(spark, d), NOW))
    return detected.unionByName(escalated).unionByName(resolved)


@query(
    "break_audits",
    with_inputs(["fx_breaks", "fx_commands"], AUDITS + """SELECT break_id, action, actor, before_status, after_status FROM audits"""),
)
def break_audits(spark, d):
    return _audits(spark, d).select(
        "break_id", "action", "actor", F.col("before.status").alias("before_status"),
        F.col("after.status").alias("after_status"),
    )


@query(
    "audit_envelope",
    with_inputs(["fx_breaks", "fx_commands"], AUDITS + f"""SELECT '1' AS schema_version, sha256(payload) AS id, {_T} AS ts,
  'tallymark' AS source_service, actor AS actor_id, concat('recon.', action) AS action, 'break' AS target_type,
  break_id AS target_id, concat('sha256:', sha256(payload)) AS payload_hash, payload FROM audits"""),
)
def audit_envelope(spark, d):
    return ev.envelope(_audits(spark, d))


@query(
    "audit_messages",
    with_inputs(["fx_breaks", "fx_commands"], AUDITS + f"""SELECT 'audit.v1' AS topic, break_id AS key,
  concat('{{"schema_version":"1","id":"', sha256(payload), '","ts":"', {_T}, '","source_service":"tallymark","actor_id":"', actor,
  '","action":"recon.', action, '","target_type":"break","target_id":"', break_id, '","payload_hash":"sha256:', sha256(payload),
  '","payload":', payload, '}}') AS value FROM audits"""),
)
def audit_messages(spark, d):
    """The messages as they are sent; the payload is an object in them."""
    return ev.as_audit_messages(_audits(spark, d))


@query(
    "lifecycle_replay",
    with_inputs(["fx_breaks", "fx_commands"], AUDITS + f""", steps AS (SELECT *,
  CASE action WHEN 'detected' THEN 0 WHEN 'escalated' THEN 1 ELSE 3 END AS stage FROM audits)
SELECT break_id, row_number() OVER (PARTITION BY break_id ORDER BY stage) AS step, action, actor, before_status AS status_before,
  after_status AS status_after, coalesce(max_by(after_status, stage) FILTER (WHERE after_status IS NOT NULL) OVER (PARTITION BY break_id), 'OPEN') AS final_status,
  epoch_us({NOW_SQL}) AS timestamp_us FROM steps"""),
)
def lifecycle_replay(spark, d):
    rows = ev.replay(_audits(spark, d))
    return rows.select(*[c for c in rows.columns if c != "timestamp"], us("timestamp"))
