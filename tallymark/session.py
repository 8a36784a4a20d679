"""Session settings and the shared folder for materialised intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app: str = "tallymark",
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster, leave `master` and `shuffle_partitions` to the submit
    command: adaptive execution sizes the partitions from a generous number.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A local session without the setting gets a temporary folder; a cluster
    session without it is refused, because executors could not see the files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _work_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes for its own use."""
    return f"{shared_folder(spark).rstrip('/')}/tallymark-{spark.sparkContext.applicationId}"


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder name for this application below the shared one."""
    return f"{_work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(frame: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    The plan behind them is cut off, lost executors cost nothing, and later
    readers open only the columns they need.
    """
    spark = frame.sparkSession
    place = run_folder(spark, "table")
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this application that no frame reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete what this application wrote for its own use. Its frames are void then."""
    delete(spark, _work_folder(spark))
