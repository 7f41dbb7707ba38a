"""The raw, clean and aggregate layers as one batch: ingest, gate, upsert, publish, log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.operators import changes
from laketide.operators import quality as dq
from laketide.sources.readers import with_audit
from laketide.sources.snapshots import SnapshotTable
from laketide.sources.writers import append

LOG_SCHEMA = "run_id string, status string, rows_read bigint, rows_valid bigint, rows_quarantined bigint, invalid_pct double, message string, finished_at timestamp_ntz"


@dataclass
class Medallion:
    """Tables live below ``root``: ``bronze`` by run, ``quarantine``, versioned ``silver`` and
    ``gold``, and ``log``. A run that fails leaves silver and gold at their last version."""

    spark: SparkSession
    root: str
    rules: Sequence[dq.Rule]
    keys: Sequence[str]
    newest_by: Sequence[str]
    clean: Callable[[DataFrame], DataFrame]
    publish: Callable[[DataFrame], DataFrame]
    limit_pct: float = 5.0
    silver: SnapshotTable = field(init=False)
    gold: SnapshotTable = field(init=False)

    def __post_init__(self) -> None:
        self.silver = SnapshotTable(self.spark, f"{self.root}/silver")
        self.gold = SnapshotTable(self.spark, f"{self.root}/gold")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")

    def _record(self, run_id: str, status: str, counts: dict, message: str | None, at: datetime) -> None:
        row = [(run_id, status, counts["total"], counts["valid"], counts["invalid"], counts["invalid_pct"], message, at)]
        append(self.spark.createDataFrame(row, LOG_SCHEMA).coalesce(1), f"{self.root}/log")

    def run(self, source: DataFrame, run_id: str, at: datetime) -> None:
        stamp = F.lit(at).cast("timestamp_ntz")
        bronze = f"{self.root}/bronze/run={run_id}"
        with_audit(source, run_id, "incremental", stamp).write.mode("overwrite").parquet(bronze)
        raw = self.spark.read.parquet(bronze).select(*source.columns)
        counts = dq.batch_metrics(raw, self.rules).first().asDict()
        try:
            dq.gate(counts, self.limit_pct)
        except dq.BatchRejected as rejected:
            self._record(run_id, "REJECTED", counts, str(rejected), at)
            raise
        good, bad = dq.split(dq.annotate(raw, self.rules, "_reason"), self.rules)
        bad_rows = dq.quarantined(bad, run_id, F.col("_reason"), stamp)
        bad_rows.write.mode("overwrite").parquet(f"{self.root}/quarantine/run={run_id}")
        fresh = self.clean(good.drop("_reason"))
        if self.silver.latest_version() is None:
            state = changes.one_row_per_key(fresh, self.keys, self.newest_by)
        else:
            state = changes.merge(self.silver.read(), fresh, self.keys, dedup_by=self.newest_by, evolve=True)
        self.silver.commit(state, "MERGE", at)
        self.gold.commit(self.publish(self.silver.read()), "PUBLISH", at)
        self._record(run_id, "SUCCESS", counts, None, at)
