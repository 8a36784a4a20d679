import csv
import json
from pathlib import Path

from helpers import T0, at, break_row, breaks_frame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import reports as rp
from tallymark.operators import views as vw


def two(spark):
    return breaks_frame(
        spark,
        break_row("a", run_id="r1", type="AMOUNT_MISMATCH", classification="REAL", external="73.25"),
        break_row("b", run_id="r1", asset="CHF", detected=60, status="RESOLVED"),
        break_row("c", run_id="r2", source="CUSTODY", detected=120),
    )


def runs(spark):
    rows = [("r1", "RAILS", "daily", "COMPLETED", 5, 1, 2, T0, at(30)), ("r3", "CUSTODY", "daily", "RUNNING", 0, 0, 0, at(60), None)]
    return spark.createDataFrame(rows, schemas.RUN)


def resolutions(spark):
    return spark.createDataFrame(
        [("a", "MANUAL", "x", "second", at(20)), ("a", "AUTO", "y", "first", at(10))], schemas.RESOLUTION)


def test_filters_and_order(spark):
    breaks = two(spark)
    ids = lambda frame: [r.break_id for r in frame.collect()]
    assert ids(vw.list_breaks(breaks)) == ["c", "b", "a"]
    assert ids(vw.list_breaks(breaks, limit=1)) == ["c"]
    assert ids(vw.list_breaks(breaks, source="RAILS", status="OPEN")) == ["a"]
    assert ids(vw.list_breaks(breaks, since=at(60), until=at(60))) == ["b"]
    assert ids(vw.list_breaks(breaks, classification="REAL", asset="CHF")) == []
    assert ids(vw.get_break(breaks, "c")) == ["c"]


def test_history(spark):
    rows = vw.break_history(two(spark), resolutions(spark)).collect()
    assert sorted((r.break_id, r.note or "") for r in rows) == [("a", "first"), ("a", "second"), ("b", ""), ("c", "")]
    one = vw.break_with_history(two(spark), resolutions(spark), "a").collect()
    assert [r.note for r in one] == ["first", "second"]


def test_runs(spark):
    assert [r.run_id for r in vw.list_runs(runs(spark)).collect()] == ["r3", "r1"]
    assert [r.run_id for r in vw.list_runs(runs(spark), "RAILS").collect()] == ["r1"]
    records = runs(spark).selectExpr("*", "0 AS seq").unionByName(
        runs(spark).where("run_id = 'r3'").selectExpr("* EXCEPT (status)", "'FAILED' AS status", "1 AS seq"))
    assert {r.run_id: r.status for r in vw.latest_runs(records).collect()} == {"r1": "COMPLETED", "r3": "FAILED"}


def test_run_report(spark):
    rows = {r.run_id: r for r in rp.run_reports(runs(spark), two(spark)).collect()}
    assert rows["r1"].breaks_by_type == {"AMOUNT_MISMATCH": 1, "TIMING_GAP": 1}
    assert rows["r1"].breaks_by_classification == {"REAL": 1, "TIMING": 1}
    assert rows["r1"].breaks_by_asset == {"USD": 1, "CHF": 1}
    assert rows["r3"].breaks_by_asset == {} and rows["r1"].matched_count == 5


def read_csv(folder):
    rows = []
    for file in sorted(Path(folder).glob("*.csv")):
        with open(file, newline="") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_export_csv_and_json(spark, tmp_path):
    rows = rp.export_rows(two(spark), status="OPEN", source="RAILS")
    rp.write_rows(rows, f"{tmp_path}/csv")
    got = read_csv(tmp_path / "csv")
    assert list(got[0]) == ["id", "type", "classification", "source", "asset", "reference", "internal_amount",
                            "external_amount", "status", "detected_at", "age_seconds"]
    assert [(r["id"], r["external_amount"], r["detected_at"]) for r in got] == [("a", "73.25000000", "2024-01-01T00:00:00+00:00")]
    rp.write_rows(rp.export_rows(two(spark), source="CUSTODY"), f"{tmp_path}/json", "json")
    body = json.loads("".join(f.read_text() for f in (tmp_path / "json").glob("*.json")))
    assert body["id"] == "c" and body["external_amount"] is None


def test_export_with_history(spark):
    rows = rp.export_history(two(spark), resolutions(spark), source="RAILS").collect()
    assert sorted((r.id, r.resolution_type or "") for r in rows) == [("a", "AUTO"), ("a", "MANUAL"), ("b", "")]


def test_archives_of_other_runs_stay(spark, tmp_path):
    for run in ("r1", "r3", "r1"):
        breaks = two(spark).withColumn("run_id", F.lit(run))
        place = rp.archive_reports(runs(spark).where(f"run_id = '{run}'"), breaks, str(tmp_path))
    counts = {r.run_id: r["count"] for r in rp.archived_files(spark, place).groupBy("run_id").count().collect()}
    assert counts == {"r1": 3, "r3": 3}


def test_archive_and_read_back(spark, tmp_path):
    place = rp.archive_reports(runs(spark), two(spark), str(tmp_path))
    assert len(read_csv(Path(place) / "run_source=RAILS" / "run_id=r1")) == 2
    back = rp.archived_files(spark, place, "RAILS")
    assert {r.break_id for r in back.collect()} == {"a", "b"}
    assert rp.archived_files(spark, place, "CUSTODY").isEmpty()


def test_report_json_lines(spark):
    rows = rp.report_json(runs(spark), two(spark)).collect()
    assert sorted((r.run_id, r.kind) for r in rows) == [("r1", "break"), ("r1", "break"), ("r1", "report"), ("r3", "report")]
    head = json.loads(next(r.json for r in rows if r.run_id == "r1" and r.kind == "report"))
    assert head["breaks_by_asset"] == {"CHF": 1, "USD": 1} and head["completed_at"] == "2024-01-01T00:00:30Z"


def test_totals_never_mix_assets(spark):
    rows = {(r.source, r.asset): r for r in rp.report_by_asset(two(spark)).collect()}
    assert rows[None, None].breaks == 3 and rows[None, None].internal_amount is None
    assert rows["RAILS", None].open_breaks == 1
    assert rows["RAILS", "USD"].internal_amount == 100


def test_empty_state(spark):
    none = breaks_frame(spark)
    assert rp.export_rows(none).isEmpty() and rp.report_counts(none).isEmpty()
    assert vw.list_breaks(none).isEmpty()
