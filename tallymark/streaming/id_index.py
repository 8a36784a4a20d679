"""Which ids are stored: an index of runs that merge geometrically, bucketed by hash.

Commit n adds a run of its own ids; every FAN runs of one level become one of
the next, so that after n commits a reader has at most (FAN - 1) * log(n) runs.
A run is cut into buckets by the hash of source and id, sorted by hash inside.
A lookup of few ids opens the buckets that they fall into and no others, and
skips row groups by their least and largest hash; many ids touch all buckets.
Nothing is ever forgotten. Which runs there should be follows from n alone; one
that was not finished is replaced by those it would have been made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source", "external_event_id"]
_ROW = "h bigint, source string, external_event_id string, bucket int"
#: Ids that are handed to the scan as a list; more are joined.
FEW = 500


class IdIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, fan: int = 8):
        self.spark, self.path, self.buckets, self.fan = spark, path.rstrip("/"), buckets, fan

    def _hashed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*KEY)
        return rows.select(h.alias("h"), *KEY, F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"))

    def _place(self, level: int, run: int) -> str:
        return f"{self.path}/level={level}/run={run}"

    def _done(self, place: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _whole(self, level: int, run: int) -> list[str]:
        """The run, or what there is of the runs below it."""
        if self._done(self._place(level, run)):
            return [self._place(level, run)]
        if not level:
            return []
        return [p for k in range(run * self.fan, (run + 1) * self.fan) for p in self._whole(level - 1, k)]

    def runs(self, before: int) -> list[str]:
        """Folders that hold the ids of commits 0 to before - 1: the digits of `before` say how many of each level."""
        out, level, rest = [], 0, max(0, before)
        while rest:
            digit = rest % self.fan
            out += [p for k in range(rest - digit, rest) for p in self._whole(level, k)]
            rest, level = rest // self.fan, level + 1
        return out

    def _read(self, places: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], _ROW)
        for place in places:
            out = out.unionByName(self.spark.read.schema(_ROW).parquet(place))
        return out

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        rows.repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").option(
            "maxRecordsPerFile", 4_000_000).partitionBy("bucket").parquet(self._place(level, run))

    def add(self, n: int, rows: DataFrame) -> None:
        """The ids of commit n, instead of those an earlier attempt added; then the merges that are due."""
        self._write(self._hashed(rows), 0, n)
        level, run = 0, n
        while (run + 1) % self.fan == 0:
            below = [p for k in range(run + 1 - self.fan, run + 1) for p in self._whole(level, k)]
            level, run = level + 1, run // self.fan
            self._write(self._read(below), level, run)

    def known(self, rows: DataFrame, before: int) -> DataFrame:
        """(source, external_event_id) of those `rows` that commits before `before` have stored."""
        asked = self._hashed(rows)
        stored = self.opened(asked, before)
        return stored.select(*KEY).join(asked.select(*KEY), KEY, "left_semi")

    def opened(self, asked: DataFrame, before: int) -> DataFrame:
        """The parts of the index that a lookup reads: buckets and row groups of a few ids, or all for many."""
        runs = self.runs(before)
        stored = self._read(runs)
        few = [r.h for r in asked.select("h").distinct().limit(FEW + 1).collect()] if runs else []
        if len(few) > FEW:
            return stored
        return stored.where(F.col("bucket").isin([h % self.buckets for h in few]) & F.col("h").isin(few))
