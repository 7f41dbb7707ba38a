"""What the optimizer must do with the plans the library declares."""

import pytest
from pyspark.sql import functions as F

from laketide.operators import changes
from laketide.operators.joins import not_in
from laketide.session import fresh_dir
from laketide.sources import writers


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark):
    path = fresh_dir(spark, "plan")
    df = spark.range(1000).select("id", (F.col("id") % 5).cast("int").alias("part"), (F.col("id") * 2).alias("v"), F.repeat(F.lit("x"), 50).alias("pad"))
    writers.overwrite(df, path, ["part"])
    return path


def test_scan_reads_only_what_is_needed(spark, stored):
    text = plan(spark.read.parquet(stored).where("part = 3 AND v > 100").select("id"))
    assert "PartitionFilters: [isnotnull(part" in text
    assert "GreaterThan(v,100)" in text
    assert "pad" not in text.split("ReadSchema")[1].splitlines()[0]


def test_merge_with_a_small_source_leaves_the_target_unshuffled(spark, stored):
    target = spark.read.parquet(stored).drop("part")
    source = spark.createDataFrame([(1, 5), (5000, 6)], "id bigint, v bigint")
    text = plan(changes.merge(target, source, ["id"]).where("pad IS NOT NULL OR pad IS NULL"))
    kept = text.split("Union")[1].split("\n   +- ")[0]
    assert "BroadcastHashJoin" in kept and "Exchange hashpartitioning" not in kept


def test_not_in_is_not_a_broadcast_of_the_subquery(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.read.parquet(stored).where("v > 10").select(F.col("v").alias("w"))
        text = plan(not_in(spark.read.parquet(stored), "id", other, "w"))
        assert "Broadcast" not in text and "SortMergeJoin LeftAnti" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clustered_files_are_skipped_by_their_statistics(spark, stored):
    path = fresh_dir(spark, "clustered")
    writers.cluster(spark.read.parquet(stored), path, ["v"], files=4)
    files = spark.read.parquet(path).where("v BETWEEN 10 AND 20").select("_metadata.file_path").distinct().count()
    assert files == 1
