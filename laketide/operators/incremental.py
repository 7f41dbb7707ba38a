"""Full and high-water-mark loads with an audit log, and the check that a re-run is safe."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from laketide.operators.sets import two_way_difference
from laketide.sources.writers import exists

LOG_SCHEMA = "run_id string, load_type string, rows_loaded bigint, high_mark bigint, loaded_at timestamp_ntz, number bigint"


class LoadMismatch(RuntimeError):
    """The stored table does not hold the rows that were read."""


RUN = "__load"


class IncrementalTable:
    """A table folder, with one partition per run, and its load log.

    Runs are numbered. A run writes the partition of the next number with overwrite and logs the
    number afterwards: a run that died is overwritten by whichever comes next, a run that is
    already in the log is skipped, and readers see the numbers from the last full load to the last
    logged run. These are two values, so a read is a range over the partitions whatever the number
    of runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def _live(self) -> tuple[int, int]:
        """The numbers of the last full load (0 without one) and of the last run."""
        ends = self.log().agg(F.max(F.when(F.col("load_type") == "full", F.col("number"))).alias("full"), F.max("number").alias("last")).first()
        return ends["full"] or 0, ends["last"] or 0

    def read(self) -> DataFrame:
        """Rows of the last full load and of all loads after it; other partitions are pruned."""
        first, last = self._live()
        if not last:
            raise ValueError(f"nothing loaded in {self.path}")
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/loads")
        return rows.where(F.col(RUN).between(first, last)).drop(RUN)

    def _write(self, df: DataFrame, run_id: str, load_type: str, mark: str, at: datetime, floor: int | None) -> int:
        number = self._live()[1] + 1
        path = f"{self.path}/loads/{RUN}={number}"
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.col(mark).cast("bigint")).alias("high"))
        counted.write.mode("overwrite").parquet(path)
        rows, high = seen.get["rows"], seen.get["high"]
        stored = self.spark.read.schema(df.schema).parquet(path).count()
        if stored != rows:
            raise LoadMismatch(f"run {run_id}: {rows} rows read, {stored} stored")
        entry = [(run_id, load_type, rows, high if high is not None else floor, at, number)]
        self.spark.createDataFrame(entry, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return rows

    def _done(self, run_id: str) -> bool:
        return not self.log().where(F.col("run_id") == run_id).isEmpty()

    def full_load(self, source: DataFrame, run_id: str, mark: str, at: datetime) -> int:
        """Replace the table; the stored count must equal the count that was read."""
        return 0 if self._done(run_id) else self._write(source, run_id, "full", mark, at, None)

    def high_mark(self) -> int | None:
        """The highest mark of the live runs."""
        return self.log().where(F.col("number") >= self._live()[0]).agg(F.max("high_mark")).first()[0]

    def incremental_load(self, source: DataFrame, run_id: str, mark: str, at: datetime) -> int:
        """Append only rows above the stored mark; the filter reaches the source scan."""
        if self._done(run_id):
            return 0
        floor = self.high_mark()
        new = source if floor is None else source.where(F.col(mark) > F.lit(floor))
        return self._write(new, run_id, "incremental", mark, at, floor)


def cost_report(log: DataFrame) -> DataFrame:
    return log.groupBy("load_type").agg(F.count("*").alias("runs"), F.sum("rows_loaded").alias("rows_loaded"))


def same_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows only one side has, and whether a re-run left the same table."""
    difference = two_way_difference(after, before)
    counts = difference.agg(
        F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed")
    )
    return counts.withColumn("same", (F.col("added") == 0) & (F.col("removed") == 0))
