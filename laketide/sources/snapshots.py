"""Versioned tables as plain folders: ``version=N`` Parquet plus one history row per commit.

A version counts only once its history row is written, so a commit that died half-way is
invisible and its folder is overwritten by the next one. One writer at a time. A table with keys
also stores the row changes of every commit, so a feed over a range of versions reads changes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from laketide.operators import changes
from laketide.sources.evolution import GrowingTable
from laketide.sources.writers import exists

HISTORY_SCHEMA = "version int, committed_at timestamp_ntz, operation string, rows_written bigint"


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.feed = GrowingTable(spark, f"{self.path}/changes", ["_commit_version"])

    def _history_path(self) -> str:
        return f"{self.path}/history"

    def history(self) -> DataFrame:
        if not exists(self.spark, self._history_path()):
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(self._history_path())

    def latest_version(self) -> int | None:
        return self.history().agg(F.max("version")).first()[0]

    def commit(self, df: DataFrame, operation: str, at: datetime) -> int:
        """Write the next version; the row count is observed while writing."""
        last = self.latest_version()
        version = 0 if last is None else last + 1
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        if self.keys:
            after = self.spark.read.parquet(f"{self.path}/version={version}")
            before = after.where("false") if last is None else self.read(last)
            moved = changes.change_feed(before, after, self.keys, version)
            self.feed.append(moved.withColumn("_commit_timestamp", F.lit(at).cast("timestamp_ntz")), overwrite_partitions=True)
        row = [(version, at, operation, seen.get["rows"])]
        self.spark.createDataFrame(row, HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(self._history_path())
        return version

    def read(self, version: int | None = None) -> DataFrame:
        last = self.latest_version()
        wanted = last if version is None else version
        if last is None or not 0 <= wanted <= last:  # versions have no gaps
            raise ValueError(f"no version {wanted} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/version={wanted}")

    def read_as_of(self, at: datetime) -> DataFrame:
        """The last version committed at or before ``at``."""
        version = self.history().where(F.col("committed_at") <= F.lit(at).cast("timestamp_ntz")).agg(F.max("version")).first()[0]
        if version is None:
            raise ValueError(f"no version of {self.path} at {at}")
        return self.read(version)

    def restore(self, version: int, at: datetime) -> int:
        """Make an old version the newest one; history stays complete."""
        return self.commit(self.read(version), f"RESTORE {version}", at)

    def changes_between(self, first: int, last: int | None = None, net: bool = False) -> DataFrame:
        """Row changes of the commits ``first`` to ``last``, both included, with ``_commit_version`` and
        ``_commit_timestamp``; ``net`` composes them to one change of a key. Rows have the common
        schema of the versions in which changes were stored."""
        newest = self.latest_version()
        last = newest if last is None else last
        if not self.keys or newest is None or not 0 <= first <= last <= newest:
            raise ValueError(f"no changes {first} to {last} of {self.path}")
        rows = self.feed.read().where(F.col("_commit_version").between(first, last))
        return changes.net_feed(rows, self.keys) if net else rows

    def changes_since(self, at: datetime, net: bool = False) -> DataFrame:
        """Row changes of all commits after a time."""
        later = self.history().where(F.col("committed_at") > F.lit(at).cast("timestamp_ntz")).agg(F.min("version")).first()[0]
        if later is None:
            return self.feed.read().where("false")
        return self.changes_between(later, net=net)
