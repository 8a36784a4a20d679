"""Listings, reports and exports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tallymark.operators import reports as rp
from tallymark.operators import views as vw
from tallymark.plans.fixtures import view, with_inputs
from tallymark.plans.registry import break_out, query, sql_break_out, us
from tallymark.session import run_folder

SINCE = datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc)
UNTIL = datetime(2024, 1, 1, 2, 0, tzinfo=timezone.utc)
IN_RANGE = "detected_at >= TIMESTAMP '2024-01-01 00:30:00' AND detected_at <= TIMESTAMP '2024-01-01 02:00:00'"
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00')"
_MONEY = "CAST(CAST({c} AS DECIMAL(28,8)) AS VARCHAR)"


def report_sql(id_name: str, alias: str = "b") -> str:
    a = alias
    return (
        f"{a}.break_id AS {id_name}, {a}.type, {a}.classification, {a}.source, {a}.asset, {a}.reference,"
        f" {_MONEY.format(c=f'{a}.internal_amount')} AS internal_amount, {_MONEY.format(c=f'{a}.external_amount')} AS external_amount,"
        f" {a}.status, {ISO.format(c=f'{a}.detected_at')} AS detected_at, {a}.age_seconds"
    )


def _breaks(spark, d):
    return view(spark, d, "fx_breaks")


@query(
    "list_breaks",
    with_inputs(["fx_breaks"], f"""SELECT {sql_break_out()}, b.age_seconds FROM fx_breaks b
WHERE source = 'RAILS' AND status = 'OPEN' AND classification = 'REAL' AND asset = 'USD' AND {IN_RANGE}
ORDER BY detected_at DESC, break_id LIMIT 1000"""),
)
def list_breaks(spark, d):
    return break_out(
        vw.list_breaks(
            _breaks(spark, d), source="RAILS", status="OPEN", classification="REAL", asset="USD",
            since=SINCE, until=UNTIL,
        )
    )


@query(
    "list_breaks_newest",
    with_inputs(["fx_breaks"], f"""SELECT {sql_break_out()}, b.age_seconds FROM fx_breaks b
ORDER BY detected_at DESC, break_id LIMIT 1000"""),
)
def list_breaks_newest(spark, d):
    return break_out(vw.list_breaks(_breaks(spark, d)))


@query(
    "break_history",
    with_inputs(["fx_breaks", "fx_resolutions"], """SELECT b.break_id, b.status, r.type AS resolution_type, r.actor, r.note,
  epoch_us(r.created_at) AS resolution_us FROM fx_breaks b LEFT JOIN fx_resolutions r ON b.break_id = r.break_id"""),
)
def break_history(spark, d):
    return vw.break_history(_breaks(spark, d), view(spark, d, "fx_resolutions")).select(
        "break_id", "status", "resolution_type", "actor", "note", us("resolution_at", "resolution_us")
    )


@query(
    "list_runs",
    with_inputs(["fx_runs"], """SELECT run_id, source, scope, status, matched_count, unmatched_count, breaks_count,
  epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us FROM fx_runs WHERE source = 'RAILS'
ORDER BY started_at DESC, run_id"""),
)
def list_runs(spark, d):
    return vw.list_runs(view(spark, d, "fx_runs"), "RAILS").select(
        "run_id", "source", "scope", "status", "matched_count", "unmatched_count", "breaks_count",
        us("started_at", "started_us"), us("completed_at", "completed_us"),
    )


COUNTS = """, counts AS (SELECT run_id, type, classification, asset, count(*) AS n FROM fx_breaks
  GROUP BY GROUPING SETS ((run_id, type), (run_id, classification), (run_id, asset)))
"""


@query("run_report_counts", with_inputs(["fx_breaks"], COUNTS + "SELECT * FROM counts"))
def run_report_counts(spark, d):
    return rp.report_counts(_breaks(spark, d))


def _map_sql(column: str) -> str:
    entry = f"concat('\"', {column}, '\":', n)"
    return (
        f"coalesce((SELECT concat('{{', string_agg({entry}, ',' ORDER BY {column}), '}}') FROM counts c"
        f" WHERE c.run_id = r.run_id AND c.{column} IS NOT NULL), '{{}}')"
    )


@query(
    "run_report",
    with_inputs(["fx_runs", "fx_breaks"], COUNTS + f"""SELECT r.run_id, r.source, r.status, r.matched_count, r.unmatched_count, r.breaks_count,
  {_map_sql("type")} AS breaks_by_type, {_map_sql("classification")} AS breaks_by_classification, {_map_sql("asset")} AS breaks_by_asset
FROM fx_runs r"""),
)
def run_report(spark, d):
    return rp.run_reports(view(spark, d, "fx_runs"), _breaks(spark, d)).select(
        "run_id", "source", "status", "matched_count", "unmatched_count", "breaks_count",
        *[F.to_json(c).alias(c) for c in ("breaks_by_type", "breaks_by_classification", "breaks_by_asset")],
    )


@query(
    "report_rows",
    with_inputs(["fx_breaks"], f"SELECT b.run_id, {report_sql('break_id')} FROM fx_breaks b"),
)
def report_rows(spark, d):
    return rp.report_rows(_breaks(spark, d))


def _json_sql(col: str, quoted: bool = True) -> str:
    text = f"concat('\"', {col}, '\"')" if quoted else f"CAST({col} AS VARCHAR)"
    return f"CASE WHEN {col} IS NULL THEN 'null' ELSE {text} END"


_BREAK_JSON = "concat('{', " + ", ',', ".join(
    f"'\"{name}\":', " + _json_sql(name, name != "age_seconds")
    for name in ("id", "type", "classification", "source", "asset", "reference", "internal_amount",
                 "external_amount", "status", "detected_at", "age_seconds")
) + ", '}')"
_ISO_Z = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "report_json",
    with_inputs(["fx_runs", "fx_breaks"], COUNTS + f""", rows AS (SELECT b.run_id, {report_sql('id')} FROM fx_breaks b)
SELECT r.run_id, 'report' AS kind, concat('{{"run_id":"', r.run_id, '","source":"', r.source, '","scope":"', r.scope, '","status":"', r.status,
  '","matched_count":', r.matched_count, ',"unmatched_count":', r.unmatched_count, ',"breaks_count":', r.breaks_count,
  ',"started_at":"', {_ISO_Z.format(c="r.started_at")}, '","completed_at":"', {_ISO_Z.format(c="r.completed_at")},
  '","breaks_by_type":', {_map_sql("type")}, ',"breaks_by_classification":', {_map_sql("classification")},
  ',"breaks_by_asset":', {_map_sql("asset")}, '}}') AS json FROM fx_runs r
UNION ALL SELECT run_id, 'break', {_BREAK_JSON} FROM rows WHERE run_id IN (SELECT run_id FROM fx_runs)"""),
)
def report_json(spark, d):
    return rp.report_json(view(spark, d, "fx_runs"), _breaks(spark, d))


@query(
    "export_breaks",
    with_inputs(["fx_breaks"], f"""SELECT {report_sql('id')} FROM fx_breaks b WHERE status = 'OPEN' AND {IN_RANGE}
ORDER BY b.detected_at DESC, b.break_id"""),
)
def export_breaks(spark, d):
    return rp.export_rows(_breaks(spark, d), status="OPEN", since=SINCE, until=UNTIL)


@query(
    "export_with_history",
    with_inputs(["fx_breaks", "fx_resolutions"], f"""SELECT {report_sql('id')}, r.type AS resolution_type, r.actor, r.note,
  {ISO.format(c="r.created_at")} AS resolution_at
FROM fx_breaks b LEFT JOIN fx_resolutions r ON b.break_id = r.break_id WHERE b.source = 'ONCHAIN'"""),
)
def export_with_history(spark, d):
    return rp.export_history(_breaks(spark, d), view(spark, d, "fx_resolutions"), source="ONCHAIN")


@query(
    "archive_reports",
    with_inputs(["fx_runs", "fx_breaks"], f"""SELECT {report_sql('break_id')}, r.source AS run_source, b.run_id
FROM fx_breaks b JOIN fx_runs r ON b.run_id = r.run_id"""),
)
def archive_reports(spark, d):
    """Write the archive in two calls and read it back."""
    root, runs, breaks = run_folder(spark, "archive"), view(spark, d, "fx_runs"), _breaks(spark, d)
    for part in ("run_id < 'run3'", "run_id >= 'run3'"):
        place = rp.archive_reports(runs.where(part), breaks.where(part), root)
    return rp.archived_files(spark, place).drop("file")


@query(
    "report_by_asset",
    with_inputs(["fx_breaks"], """SELECT source, asset, count(*) AS breaks, count(*) FILTER (WHERE status = 'OPEN') AS open_breaks,
  count(*) FILTER (WHERE classification = 'REAL') AS real_breaks,
  CAST(CASE WHEN grouping(asset) = 0 THEN sum(internal_amount) END AS DECIMAL(38,8)) AS internal_amount,
  CAST(CASE WHEN grouping(asset) = 0 THEN sum(external_amount) END AS DECIMAL(38,8)) AS external_amount
FROM fx_breaks GROUP BY ROLLUP (source, asset)"""),
)
def report_by_asset(spark, d):
    return rp.report_by_asset(_breaks(spark, d))
