import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laketide.operators import joins
from laketide.operators.aggregates import (
    duplicate_keys,
    exact_quantiles,
    group_skew,
    null_counts,
    profile,
    reconcile,
    salted_sums,
)
from laketide.operators.sets import two_way_difference, union_by_name


@pytest.mark.parametrize("limit", [0, 5, 10_000])
def test_exact_quantiles_match_numpy(spark, limit):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "a", "a", "b", None]), float(rnd.randint(0, 60))) for _ in range(400)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.q0, r.q1) for r in exact_quantiles(df, "v", [0.5, 0.83], ["k"], 8, limit).collect()}
    assert set(got) == {"a", "b", None}
    for k in ("a", "b", None):
        values = [v for key, v in data if key == k and v is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(values, [0.5, 0.83])))
    overall = exact_quantiles(df, "v", [0.25], (), 8, limit).first().q0
    assert overall == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.25))
    assert [r.q0 for r in exact_quantiles(df.where("false"), "v", [0.5], (), 8, limit).collect()] == [None]


def test_exact_quantiles_narrow_without_storing_values(spark, monkeypatch):
    """Skewed values, one that a third of the rows hold, both ends: few scans, one stored row a group."""
    from laketide.operators import aggregates

    tables = []
    kept = aggregates.stored
    monkeypatch.setattr(aggregates, "stored", lambda df, label: tables.append(kept(df, label)) or tables[-1])
    x = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.exp((F.xxhash64("id") % 1000) / 20.0))
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), x.alias("v")).cache()
    wanted = [0.0, 0.1, 0.5, 0.6, 1.0]
    got = {r.k: list(r)[1:] for r in exact_quantiles(df, "v", wanted, ["k"], 16, 50).collect()}
    for k in (0, 1):
        assert got[k] == pytest.approx(np.quantile([r.v for r in df.where(F.col("k") == k).collect()], wanted).tolist())
    assert len(tables) <= 6 and all(t.count() == 2 for t in tables)


def test_salted_sum_equals_plain_sum_with_one_hot_key(spark, rows):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id", (F.col("id") % 7).alias("v")
    )
    plain = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert rows(salted_sums(df, ["k"], ["id"], {"s": F.col("v")})) == rows(plain)
    skew = group_skew(df, "k").first()
    assert skew.largest == 18_000 and skew.skew_ratio > 100


def test_salted_layout_is_balanced(spark):
    from laketide.operators.aggregates import rows_per_partition, salt_of

    df = spark.range(20_000).withColumn("k", F.lit("hot"))
    plain = rows_per_partition(df.repartition(16, "k")).agg(F.max("rows")).first()[0]
    spread = rows_per_partition(df.withColumn("salt", salt_of("id", salts=64)).repartition(16, "k", "salt")).agg(F.max("rows")).first()[0]
    assert plain == 20_000 and spread * 3 <= plain


def test_profile_nulls_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 4.0), (None, 6.0)], "k int, v double")
    assert null_counts(df).first().asDict() == {"k": 1, "v": 1}
    assert [(r.k, r.copies) for r in duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    p = profile(df, ["v"]).first()
    assert (p.n, p.mean, p.min, p.max, p.stddev) == (3, 4.0, 2.0, 6.0, 2.0)


def test_reconcile_reports_missing_keys(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, m double")
    b = spark.createDataFrame([("x", 1.005), ("z", 2.0)], "k string, m double")
    got = {r.k: r.matches for r in reconcile(a, b, ["k"], "m").collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "a int, b string")
    got = sorted((r.a, r.side) for r in two_way_difference(a, b).collect())
    assert got == [(1, "added"), (2, "added"), (3, "removed")]
    wide = union_by_name([a, spark.createDataFrame([(9, 1.5)], "a int, c double")])
    assert wide.columns == ["a", "b", "c"] and wide.where("a = 9").first().b is None


# ---- joins -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "other, want",
    [([], [1, 2, None]), ([2], [1]), ([2, None], []), ([7], [1, 2])],
)
def test_not_in_follows_sql_null_rules(spark, other, want):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    values = spark.createDataFrame([(v,) for v in other], "y int")
    assert [r.x for r in joins.not_in(df, "x", values, "y").orderBy(F.asc_nulls_last("x")).collect()] == want


def test_broadcast_only_below_the_measured_size(spark):
    fact, dim = spark.range(100), spark.range(50).withColumn("name", F.repeat(F.lit("x"), 100))

    def plan(side):
        return fact.join(side, "id")._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in plan(joins.broadcast_if_small(dim))
    assert "broadcast" not in plan(joins.broadcast_if_small(dim, max_rows=49))
    assert "broadcast" not in plan(joins.broadcast_if_small(dim, max_bytes=1000))


def test_side_by_side_equals_a_full_outer_chain(spark, rows):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id int, a int")
    b = spark.createDataFrame([(2, "x"), (3, None)], "id int, b string")
    c = spark.createDataFrame([(4, 1.5), (1, 2.5)], "id int, c double")
    fill = {"a": 0, "c": 0.0}
    assert rows(joins.side_by_side([a, b, c], "id", fill)) == rows(joins.full_outer([a, b, c], "id", fill))


def test_orphans_and_changes(spark):
    child = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id int, ref string")
    parent = spark.createDataFrame([("a",)], "key string")
    assert sorted(r.id for r in joins.orphans(child, parent, "ref", "key").collect()) == [2, 3]
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d"), (4, "e")], "id int, v string")
    assert sorted(r.id for r in joins.changed(new, old, ["id"], ["v"]).collect()) == [2, 3]
    assert sorted(r.id for r in joins.changed(new, old, ["id"], ["v"], null_safe=False).collect()) == [3]
