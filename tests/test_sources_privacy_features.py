import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from laketide.functions import masking
from laketide.operators import drift, features, model, monitoring, privacy
from laketide.plans.medallion import Medallion
from laketide.operators import quality as dq
from laketide.session import fresh_dir, shared_dir
from laketide.sources import evolution, readers, writers

# ---- sources and sinks ------------------------------------------------------------------------


def test_inferred_ids_lose_zeros_and_declared_ones_do_not(spark):
    path = fresh_dir(spark, "csv")
    spark.createDataFrame([("000000001", "x")], "tax_id string, name string").write.option("header", True).csv(path)
    assert readers.read_csv(spark, path).first().tax_id == 1
    assert readers.read_csv(spark, path, "tax_id string, name string").first().tax_id == "000000001"


def test_rescue_keeps_unknown_columns_and_misfits(spark):
    df = spark.createDataFrame([(1, "5", "x", None), (2, "bad", None, None), (3, None, None, 1.5)], "id int, n string, extra string, more double")
    expected = spark.createDataFrame([], "id int, n int, region string").schema
    got = {r.id: (r.n, r.region, r._rescued_data) for r in evolution.rescue_columns(df, expected).collect()}
    assert got == {1: (5, None, '{"extra":"x"}'), 2: (None, None, '{"n":"bad"}'), 3: (None, None, '{"more":1.5}')}
    plain = evolution.rescue_columns(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], "id int").schema)
    assert plain.first()._rescued_data is None


def test_only_the_loaded_partition_is_replaced(spark):
    path = fresh_dir(spark, "p")
    days = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "day int, v string")
    writers.replace_partitions(days, path, ["day"])
    for _ in range(2):
        writers.replace_partitions(spark.createDataFrame([(1, "z")], "day int, v string"), path, ["day"])
    assert sorted((r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_compaction_and_clustering(spark):
    small, large, ordered = (fresh_dir(spark, n) for n in ("small", "large", "ordered"))
    spark.range(1000).withColumn("k", F.col("id") % 100).repartition(10).write.parquet(small)
    writers.compact(spark, small, large)
    assert (writers.file_counts(spark, small).first().files, writers.file_counts(spark, large).first().files) == (10, 1)
    writers.cluster(spark.read.parquet(small), ordered, ["k"], files=5)
    ranges = spark.read.parquet(ordered).groupBy("_metadata.file_path").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(ranges) == 5 and all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))


def test_load_if_missing_builds_once(spark):
    path, calls = fresh_dir(spark, "t"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert readers.load_if_missing(spark, path, build).count() == readers.load_if_missing(spark, path, build).count() == 3
    assert calls == [1]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or shared_dir(spark)).rstrip("/")
    assert fresh_dir(spark, "x").startswith(shared_dir(spark)) and fresh_dir(spark, "x") != fresh_dir(spark, "x")


# ---- layers -----------------------------------------------------------------------------------


def test_layers_keep_their_state_when_a_batch_is_rejected(spark):
    flow = Medallion(
        spark, fresh_dir(spark, "m"), [dq.Rule("id", F.col("id").isNull())], ["id"], ["seq"],
        clean=lambda df: df, publish=lambda df: df.agg(F.count("*").alias("n"), F.sum("v").alias("v")), limit_pct=40.0,
    )
    schema = "id int, seq int, v int"
    flow.run(spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5), (None, 1, 0)], schema), "r1", datetime(2024, 1, 1))
    assert tuple(flow.gold.read().first()) == (2, 25)
    with pytest.raises(dq.BatchRejected):
        flow.run(spark.createDataFrame([(None, 1, 0), (3, 1, 1)], schema), "r2", datetime(2024, 1, 2))
    assert tuple(flow.gold.read().first()) == (2, 25)
    flow.run(spark.createDataFrame([(2, 9, 50), (3, 1, 1)], schema), "r3", datetime(2024, 1, 3))
    assert tuple(flow.gold.read().first()) == (3, 71)
    assert [(r.run_id, r.status, r.rows_quarantined) for r in flow.log().orderBy("run_id").collect()] == [
        ("r1", "SUCCESS", 1), ("r2", "REJECTED", 1), ("r3", "SUCCESS", 0)
    ]


# ---- privacy ----------------------------------------------------------------------------------


def test_masks(spark):
    row = spark.createDataFrame([("123456789", "GR1601101250", "maria@x.gr", "Maria Papa", 50000.0)], "afm string, iban string, mail string, name string, income double")
    got = row.select(
        masking.keep_last("afm"), masking.keep_ends("iban"), masking.email("mail"), masking.initial_and_last_name("name"),
        masking.first_letter_only("name"), masking.income_band("income"),
    ).first()
    assert tuple(got) == ("*****6789", "GR****1250", "m***@x.gr", "M. Papa", "M***", "30k–70k")
    bands = spark.createDataFrame([(29999.99,), (30000.0,), (70000.0,), (None,)], "v double").select(masking.income_band("v").alias("b"))
    assert [r.b for r in bands.collect()] == ["< 30k", "30k–70k", "70k+", None]
    one_word = spark.createDataFrame([("Plato",)], "n string").select(masking.initial_and_last_name("n").alias("n")).first().n
    assert one_word == "P. "
    with pytest.raises(ValueError):
        masking.mask_by_contract(row, {"afm": "rot13"})


def test_roles_and_entitlements(spark):
    roles = spark.createDataFrame([("a@x", "analyst"), ("e@x", "data_engineer")], "email string, role string")
    assert [privacy.role_of(roles, u) for u in ("a@x", "e@x", "who@x")] == ["analyst", "data_engineer", "public"]
    people = spark.createDataFrame([("1", "north"), ("2", "south"), ("3", None)], "id string, region string")
    grants = spark.createDataFrame([("a@x", "north"), ("a@x", "north"), ("e@x", "south")], "user_email string, allowed_region string")
    assert [r.id for r in privacy.entitled_rows(people, grants, "a@x", "region").collect()] == ["1"]
    assert privacy.entitled_rows(people, grants, "who@x", "region").isEmpty()
    check = privacy.token_check(people, "id", masking.token("id", "salt")).first()
    assert (check.distinct_values, check.distinct_tokens, check.one_to_one) == (3, 3, True)


# ---- features, models, drift --------------------------------------------------------------------


def two_samples(spark, n=300):
    rnd = random.Random(11)
    ref = [float(rnd.randint(0, 40)) for _ in range(n)]
    cur = [float(rnd.randint(5, 50)) for _ in range(n // 2)]
    df = spark.createDataFrame([(v, False) for v in ref] + [(v, True) for v in cur] + [(None, True)], "x double, late boolean")
    return df, np.array(ref), np.array(cur)


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_ks_matches_a_direct_computation(spark, hot_rows):
    df, ref, cur = two_samples(spark)
    points = np.union1d(ref, cur)
    gap = max(abs((cur <= p).mean() - (ref <= p).mean()) for p in points)
    got = drift.ks(df, F.col("late"), "x", 10, 8, hot_rows).first()
    assert got.ks_statistic == pytest.approx(gap, abs=1e-9)
    root = math.sqrt(len(ref) * len(cur) / (len(ref) + len(cur)))
    lam = gap * (root + 0.12 + 0.11 / root)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert got.ks_pvalue == pytest.approx(min(max(p, 0), 1), abs=1e-9)


def test_psi_matches_a_direct_computation(spark):
    df, ref, cur = two_samples(spark)
    edges = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()), 11)
    r, c = (np.histogram(s, edges)[0] / len(s) for s in (ref, cur))
    r, c = np.where(r == 0, 1e-6, r), np.where(c == 0, 1e-6, c)
    got = drift.psi(drift.histograms(df, F.col("late"), ["x"]), 9).first()
    assert got.psi == pytest.approx(float(np.sum((c - r) * np.log(c / r))), abs=1e-8)
    same = drift.psi(drift.histograms(df.select("x", (F.rand(1) < 2).alias("late")).union(df.select("x", F.lit(False))), F.col("late"), ["x"])).first()
    assert same.psi == pytest.approx(0.0, abs=1e-9) and same.severity == "ok"


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_auc_counts_ties_half(spark, hot_rows):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 1), float(rnd.randint(0, 12))) for _ in range(200)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = model.auc(spark.createDataFrame(data, "y int, s double"), "y", "s", 6, hot_rows).first().auc
    assert got == pytest.approx(want)


def test_correlations_leakage_and_splits(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2 * 3 + 1).alias("leak"), F.lit(7).alias("flat"), (F.col("id") % 13).alias("noise"))
    got = {r.feature: r for r in features.leakage_tiers(features.feature_correlations(df, ["leak", "flat", "noise"], "y")).collect()}
    assert got["leak"].tier == "leakage" and got["flat"].tier == "undefined" and got["noise"].tier == "ok"
    assert got["noise"].correlation == pytest.approx(np.corrcoef([i % 13 for i in range(200)], [i % 2 for i in range(200)])[0, 1], abs=1e-6)
    train, test = features.temporal_split(df, "id", F.lit(150), drop=["leak"])
    assert (train.count(), test.count()) == (150, 50) and "leak" not in train.columns
    parts = features.stratified_split(spark.range(20_000).withColumn("y", F.col("id") % 3), "id", "y").groupBy("y").agg(F.avg((F.col("split") == "train").cast("int")).alias("p"))
    assert all(abs(r.p - 0.8) < 0.02 for r in parts.collect())


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 10.0), (None, 20.0), (9.0, 30.0)], "a double, b double")
    assert [r.a for r in features.median_impute(df, ["a", "b"], exact=True).collect()] == [1.0, 2.0, 2.0, 9.0]
    assert [r.b for r in features.median_impute(df, ["a", "b"]).collect()] == [20.0, 10.0, 20.0, 30.0]


def test_forest_scores_are_reproducible_and_audited(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), ((F.col("id") % 20) > 14).cast("int").alias("y"))
    forest = model.train_forest(df, ["x", "z"], "y", trees=5, depth=4)
    scored = model.score(df, forest, ["x", "z"], "v3", F.lit("2024-01-01").cast("timestamp_ntz"))
    metrics = model.classification_metrics(scored, "y", "prediction").first()
    assert metrics.accuracy > 0.99 and metrics.tp + metrics.fn == 100
    assert list(model.importances(forest, ["x", "z"]))[0] == "x"
    assert scored.select("model_version").distinct().first()[0] == "v3"
    assert scored.select("input_hash").distinct().count() == df.select("x", "z").distinct().count()


# ---- monitoring -----------------------------------------------------------------------------------


def test_run_log_reports(spark):
    day = lambda d: datetime(2024, 1, d)
    log = [(1, i, day(i), day(i), "FAILED" if i in (3, 9) else "SUCCEEDED", 60.0) for i in range(1, 15)]
    runs = spark.createDataFrame(log, "job_id int, run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, state string, duration_s double")
    summary = monitoring.success_summary(runs).first()
    assert summary.succeeded == 12 and round(summary.success_rate_pct, 1) == 85.7
    jobs = spark.createDataFrame([(1, "a", "o", None), (2, "idle", "o", None), (3, "gone", "o", day(1))], "job_id int, name string, owner string, deleted_at timestamp_ntz")
    as_of = F.lit(day(15)).cast("timestamp_ntz")
    health = {r.job_name: (r.total_runs, r.health_status) for r in monitoring.job_health(runs, jobs, as_of).collect()}
    assert health == {"a": (7, "WATCH"), "idle": (0, "NO RUNS")}
    assert monitoring.recent_failures(runs, jobs).count() == 2
    empty = monitoring.success_summary(runs.where("1 = 0")).first()
    assert empty.total_runs == 0 and empty.success_rate_pct is None


def test_a_reloaded_day_without_rows_is_emptied(spark):
    path = fresh_dir(spark, "empty_day")
    days = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "day int, v string")
    writers.replace_partitions(days, path, ["day"])
    writers.replace_partitions(days.where("false"), path, ["day"], values=[{"day": 1}])
    assert [tuple(r) for r in spark.read.parquet(path).select("day", "v").collect()] == [(2, "c")]


def test_a_large_partition_is_written_by_several_tasks(spark):
    path = fresh_dir(spark, "rebalanced")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100k")
    try:
        rows = spark.range(0, 300_000, numPartitions=8).select(F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        writers.replace_partitions(rows, path, ["day"])
    finally:
        spark.conf.set(size, before)
    files = spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct().groupBy("day").count()
    assert {r["day"]: r["count"] for r in files.collect()}[1] > 1
    assert spark.read.parquet(path).count() == 300_000
