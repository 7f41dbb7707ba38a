"""Headline queries, timed one after the other. Prints one JSON line.

    BENCH_SF_DIR   table folder      (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] threads  (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from laketide.plans import catalog  # noqa: E402
from laketide.session import build_session  # noqa: E402

HEADLINE = [
    "parquet_scan",
    "gold_category_region",
    "join_left_enrich",
    "join_broadcast",
    "join_sort_merge",
    "perf_recipe",
    "agg_count_distinct",
    "salted_agg",
    "exact_quantiles",
    "dedup_latest",
    "topk_per_group",
    "running_total",
    "running_total_hot_key",
    "lag_lead",
    "contract_report",
    "contract_split",
    "rule_table_eval",
    "issue_report",
    "cleanse_orders",
    "merge_upsert_all",
    "merge_cdc_ops",
    "change_feed",
    "affected_recompute",
    "scd2_merge",
    "gold_sector_region",
    "citizen_360_left",
    "citizen_360_full",
    "audit_priority_top100",
    "daily_kpis",
    "feature_table",
    "psi_drift",
    "ks_drift",
    "job_health",
    "tokenize_sha2",
    "replace_partition",
    "cluster_layout",
    "stream_tumbling_agg",
    "stream_dq_upsert",
]


def drain(df) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-bench-", dir="/tmp"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    drain(catalog.QUERIES["gold_category_region"](spark, sf_dir))  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        drain(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
