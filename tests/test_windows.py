import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from laketide.functions.scalars import bucket_by_bounds
from laketide.operators.windows import (
    bounded_frame,
    latest_per_key,
    prefix_sums,
    range_chunks,
    strictly_past,
    top_k_per_group,
    top_n_ranked,
    with_group_stats,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows on one key, a NULL key, tied and missing times."""
    rnd = random.Random(7)
    keys = ["hot"] * 20 + ["a", "b", None, "c", None]
    data = [(i, rnd.choice(keys), rnd.choice([None] + list(range(12))), rnd.randint(-50, 50)) for i in range(600)]
    return spark.createDataFrame(data, "id bigint, k string, t int, v bigint").repartition(5)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("hot_rows", [1, 30, 10_000])
def test_prefix_sums_equal_a_plain_window(skewed, rows, inclusive, hot_rows):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = skewed.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count("v").over(w).alias("n"))
    sums = {"s": F.col("v"), "n": F.lit(1).cast("bigint")}
    got = prefix_sums(skewed, ["k"], ["t", "id"], sums, F.col("t"), inclusive, hot_rows).select("id", "s", "n")
    assert rows(got) == rows(want)


def test_prefix_sums_over_one_global_order(skewed, rows):
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", F.sum("v").over(w).alias("s"))
    chunk = range_chunks(skewed.withColumn("id", F.col("id").cast("double")), "id", 8)
    got = prefix_sums(skewed, [], ["id"], {"s": F.col("v")}, chunk, hot_rows=10).select("id", "s")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows, block", [(1, 3), (1, 7), (40, 5), (10_000, 5)])
def test_bounded_frame_equals_a_plain_window(skewed, rows, hot_rows, block):
    columns = {
        "p": lambda w: F.lag("v", 2).over(w),
        "n": lambda w: F.lead("v").over(w),
        "m": lambda w: F.sum("v").over(w.rowsBetween(-3, 0)),
    }
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("id", *[make(w).alias(n) for n, make in columns.items()])
    got = bounded_frame(skewed, ["k"], ["t", "id"], columns, F.col("t"), 3, 1, hot_rows, block)
    assert rows(got.select("id", *columns)) == rows(want)


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_strictly_past_leaves_out_rows_of_the_same_time(skewed, rows, hot_rows):
    known = skewed.where("t IS NOT NULL")
    w = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    want = known.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    got = strictly_past(known, ["k"], "t", {"s": F.col("v")}, F.col("t"), hot_rows).select("id", "s")
    assert rows(got) == rows(want)


def test_latest_per_key_breaks_ties_by_the_whole_row(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, None, "q"), (None, 1, "n"), (None, 2, "m")], "k int, t int, x string")
    got = latest_per_key(df, ["k"], ["t"])
    assert got.columns == df.columns
    assert {(r.k, r.t, r.x) for r in got.collect()} == {(1, 5, "b"), (2, None, "q"), (None, 2, "m")}
    shuffled = latest_per_key(df.repartition(6), ["k"], ["t"])
    assert rows(shuffled) == rows(got)


def test_group_stats_keep_rows_with_a_null_key(skewed, rows):
    w = Window.partitionBy("k")
    want = skewed.select("id", F.sum("v").over(w).alias("s"))
    assert rows(with_group_stats(skewed, ["k"], {"s": F.sum("v")}).select("id", "s")) == rows(want)


def test_top_k_and_global_rank(skewed, rows):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    want = skewed.withColumn("rnk", F.row_number().over(w)).where("rnk <= 4")
    got = top_k_per_group(skewed, ["k"], [F.desc("v"), F.col("id")], 4)
    assert rows(got) == rows(want)
    best = [(r.id, r.place) for r in top_n_ranked(skewed, [F.desc("v"), F.col("id")], 3, "place").collect()]
    assert best == [(r.id, i) for i, r in enumerate(skewed.orderBy(F.desc("v"), "id").take(3), start=1)]


def test_hot_groups_are_cut_before_the_shuffle(skewed):
    plan = top_k_per_group(skewed, ["k"], [F.desc("v")], 2, "rank")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 20, 255, 256])
def test_buckets_count_the_bounds_below(spark, n):
    rnd = random.Random(n)
    bounds = [rnd.randint(-40, 40) / 2 for _ in range(n)]
    values = [v / 4 for v in range(-100, 100, 3)] + [float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [(r.v, r.b) for r in df.select("v", bucket_by_bounds("v", bounds).alias("b")).collect() if r.v != float("inf")]
    assert got == [(v, sum(b <= v for b in bounds)) for v in values if v != float("inf")]
    assert spark.createDataFrame([(None,)], "v double").select(bucket_by_bounds("v", bounds)).first()[0] == 0


@pytest.mark.parametrize("order", ["id", "-id", "id DESC NULLS FIRST", "id ASC NULLS LAST"])
def test_both_paths_agree_in_rows_types_and_columns(spark, order):
    """A sum that replaces a column, decimals, NULLs in the order, both directions."""
    rows = [("a", i if i % 7 else None, i, str(i)) for i in range(60)] + [("b", 1, 5, "x"), (None, 2, 6, None)]
    df = spark.createDataFrame(rows, "k string, id int, v int, s string").select("k", "id", F.col("v").cast("decimal(18,2)").alias("v"), "s")
    by = {"id": F.col("id").asc(), "-id": F.col("id").desc(), "id DESC NULLS FIRST": F.col("id").desc_nulls_first(), "id ASC NULLS LAST": F.col("id").asc_nulls_last()}[order]
    chunk = F.floor(F.col("id") / 10)
    got = [prefix_sums(df, ["k"], [by, F.col("s")], {"v": F.col("v"), "n": F.lit(1)}, chunk, True, hot) for hot in (1, 10**6)]
    assert got[0].schema == got[1].schema or got[0].dtypes == got[1].dtypes
    assert sorted(map(repr, got[0].collect())) == sorted(map(repr, got[1].collect()))
