"""Run reports, exports and the report archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.scalars import iso_offset, iso_z, json_with_nulls, money_text
from tallymark.operators.views import break_history, filter_breaks

_GROUPS = ("type", "classification", "asset")


def _report_columns(id_name: str) -> list[Column]:
    """The eleven columns of reports and exports, amounts and times as text."""
    return [
        F.col("break_id").alias(id_name),
        *[F.col(c) for c in ("type", "classification", "source", "asset", "reference")],
        money_text("internal_amount").alias("internal_amount"),
        money_text("external_amount").alias("external_amount"),
        F.col("status"),
        iso_offset("detected_at").alias("detected_at"),
        F.col("age_seconds"),
    ]


def report_counts(breaks: DataFrame) -> DataFrame:
    """Breaks per run by type, by classification and by asset.

    Rows are counted once per combination; the three groupings are made from
    those counts.
    """
    counts = breaks.groupBy("run_id", *_GROUPS).agg(F.count("*").alias("_n"))
    sets = [[F.col("run_id"), F.col(c)] for c in _GROUPS]
    return counts.groupingSets(sets, "run_id", *_GROUPS).agg(F.sum("_n").alias("n"))


def run_reports(runs: DataFrame, breaks: DataFrame) -> DataFrame:
    """Each run with its stored counters and the three count maps.

    A map has one entry per value, not per break.
    """
    counts = report_counts(breaks)

    def as_map(column: str) -> Column:
        given = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("key"), F.col("n").alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(given))).alias(f"breaks_by_{column}")

    maps = counts.groupBy("run_id").agg(*[as_map(c) for c in _GROUPS])
    empty = F.create_map().cast("map<string,bigint>")
    joined = runs.join(maps, "run_id", "left")
    return joined.select(
        *runs.columns, *[F.coalesce(f"breaks_by_{c}", empty).alias(f"breaks_by_{c}") for c in _GROUPS]
    )


def report_rows(breaks: DataFrame, run_id: str | None = None) -> DataFrame:
    """Per-break rows of the report of one run, or of all runs."""
    found = breaks if run_id is None else breaks.where(F.col("run_id") == run_id)
    return found.select("run_id", *_report_columns("break_id"))


def report_json(runs: DataFrame, breaks: DataFrame) -> DataFrame:
    """Reports as JSON lines (run_id, kind, json): a `report` line per run with
    counters and maps, and a `break` line per break.

    One document per run would put all its breaks into one value.
    """
    headers = run_reports(runs, breaks)
    fields = [
        iso_z(c).alias(c) if c in ("started_at", "completed_at") else F.col(c)
        for c in headers.columns
    ]
    head = headers.select(
        "run_id", F.lit("report").alias("kind"), json_with_nulls(F.struct(*fields)).alias("json")
    )
    known = breaks.join(runs.select("run_id"), "run_id", "left_semi")
    body = known.select(
        "run_id",
        F.lit("break").alias("kind"),
        json_with_nulls(F.struct(*_report_columns("id"))).alias("json"),
    )
    return head.unionByName(body)


def export_rows(breaks: DataFrame, **conditions) -> DataFrame:
    """Filtered breaks for export, newest first, all of them."""
    found = filter_breaks(breaks, **conditions)
    return found.orderBy(F.desc("detected_at"), "break_id").select(*_report_columns("id"))


def export_history(breaks: DataFrame, resolutions: DataFrame, **conditions) -> DataFrame:
    """The export with one row per resolution of each break."""
    rows = break_history(filter_breaks(breaks, **conditions), resolutions)
    return rows.select(
        *_report_columns("id"), "resolution_type", "actor", "note",
        iso_offset("resolution_at").alias("resolution_at"),
    )


def write_rows(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write export or report rows as CSV (with header) or JSON lines."""
    writer = rows.write.mode("overwrite")
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.option("header", "true").option("emptyValue", "").csv(path)


ROWS_PER_FILE = 200_000


def archive_reports(runs: DataFrame, breaks: DataFrame, root: str) -> str:
    """One folder of CSV files per run: `reports/run_source=…/run_id=…`.

    Folders of other runs stay as they are. A run is spread over as many tasks
    as its breaks ask for.
    """
    place = f"{root}/reports"
    sizes = breaks.groupBy("run_id").agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("_files"))
    known = runs.select("run_id", F.col("source").alias("run_source")).join(sizes, "run_id")
    rows = report_rows(breaks).join(known, "run_id")
    rows = rows.withColumn("_file", F.pmod(F.xxhash64("break_id"), F.col("_files")))
    (
        rows.repartition("run_source", "run_id", "_file")
        .drop("_file", "_files")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_source", "run_id")
        .option("header", "true")
        .csv(place)
    )
    return place


def archived_files(spark: SparkSession, place: str, source: str | None = None) -> DataFrame:
    """Archived rows below a prefix with the file each came from."""
    schema = (
        "break_id string, type string, classification string, source string, asset string,"
        " reference string, internal_amount string, external_amount string, status string,"
        " detected_at string, age_seconds bigint, run_source string, run_id string"
    )
    rows = spark.read.schema(schema).option("header", "true").csv(place)
    rows = rows if source is None else rows.where(F.col("run_source") == source)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def report_by_asset(breaks: DataFrame) -> DataFrame:
    """Counts and amounts per source and asset, with subtotals per source and overall.

    Amounts of different assets are never added up.
    """
    fine = breaks.groupBy("source", "asset").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("status") == "OPEN").alias("_open"),
        F.count_if(F.col("classification") == "REAL").alias("_real"),
        F.sum("internal_amount").cast("decimal(38,8)").alias("_internal"),
        F.sum("external_amount").cast("decimal(38,8)").alias("_external"),
    )
    per_asset = F.grouping("asset") == 0
    return fine.rollup("source", "asset").agg(
        F.sum("_n").alias("breaks"),
        F.sum("_open").alias("open_breaks"),
        F.sum("_real").alias("real_breaks"),
        F.when(per_asset, F.sum("_internal")).cast("decimal(38,8)").alias("internal_amount"),
        F.when(per_asset, F.sum("_external")).cast("decimal(38,8)").alias("external_amount"),
    )
