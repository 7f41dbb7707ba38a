"""Totals kept by retraction against totals of the whole state, and what a batch reads."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from laketide.session import fresh_dir
from laketide.streaming.batches import GroupTotals, UpsertSink

ROWS = "id int, seen int, g string, v int, w decimal(9,2)"


def make(spark, root, newest_wins=True, buckets=4):
    schema = spark.createDataFrame([], ROWS).schema
    gold = GroupTotals(spark, f"{root}/gold", schema, {"g": F.col("g")}, {"w": F.col("w")}, {"v": F.col("v")}, buckets=buckets)
    return UpsertSink(spark, f"{root}/state", schema, ["id"], ["seen"], gold=gold, newest_wins=newest_wins, buckets=buckets), gold


def totals(df):
    return {(r.g, r.rows, None if r.w_n == 0 else r.w, r.w_n, r.v_min, r.v_max) for r in df.collect()}


def direct(state):
    out = state.groupBy("g").agg(F.count("*").alias("rows"), F.sum("w").alias("w"), F.count("w").alias("w_n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    return totals(out)


@pytest.mark.parametrize("newest_wins", [True, False])
def test_random_batches(spark, newest_wins):
    rng = random.Random(11)
    sink, gold = make(spark, fresh_dir(spark, "r"), newest_wins)
    for b in range(5):
        rows = [
            (rng.randrange(12), rng.randrange(b * 3, b * 3 + 6), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 1, 2]))
            for _ in range(rng.randrange(1, 9))
        ]
        sink(spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4])) for r in rows], ROWS), b)
        assert totals(gold.current(b)) == direct(sink.current(b))
        if b == 2:
            sink.compact()
            gold.compact(b)
    assert totals(gold.current(4)) == direct(sink.current(4))


def test_moves_extremes_and_empty_groups(spark):
    sink, gold = make(spark, fresh_dir(spark, "r"))

    put = lambda b, *rows: sink(spark.createDataFrame(list(rows), ROWS), b)
    put(0, (1, 1, "a", 5, Decimal(1)), (2, 1, "a", 9, Decimal(2)), (3, 1, "b", 7, None))
    put(1, (2, 2, "b", 9, Decimal(3)))  # the maximum of a moves to b
    assert totals(gold.current(1)) == {("a", 1, Decimal(1), 1, 5, 5), ("b", 2, Decimal(3), 1, 7, 9)}
    put(2, (1, 2, "b", 5, Decimal(1)))  # a has no row left
    assert totals(gold.current(2)) == {("b", 3, Decimal(4), 2, 5, 9)}
    put(3, (1, 1, "a", 0, Decimal(100)))  # too late
    assert totals(gold.current(3)) == {("b", 3, Decimal(4), 2, 5, 9)}
    put(4, (1, 3, "a", None, None))
    assert totals(gold.current(4)) == {("a", 1, None, 0, None, None), ("b", 2, Decimal(3), 1, 7, 9)}


def test_a_batch_that_died_is_folded_once(spark):
    root = fresh_dir(spark, "r")
    sink, gold = make(spark, root)

    sink(spark.createDataFrame([(1, 1, "a", 5, Decimal(1))], ROWS), 0)
    dying, half = make(spark, root)
    dying.log.add = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        dying(spark.createDataFrame([(1, 2, "b", 6, Decimal(9)), (2, 2, "a", 4, Decimal(7))], ROWS), 1)
    again, gold = make(spark, root)
    again(spark.createDataFrame([(1, 2, "b", 6, Decimal(9)), (2, 2, "a", 4, Decimal(7))], ROWS), 1)
    assert totals(gold.current(again.log.last())) == direct(again.current()) == {("a", 1, Decimal(7), 1, 4, 4), ("b", 1, Decimal(9), 1, 6, 6)}


def buckets_read(df):
    """For each scan of bucketed rows, how many buckets its partition filter lets through."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")
    out = []
    for filters in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString()):
        listed = re.search(r"__bucket#\d+L? (?:IN \(([\d,]+)\)|= (\d+))", filters)
        if listed:
            out.append(len((listed[1] or listed[2]).split(",")))
    return out


def test_a_batch_reads_only_the_buckets_of_its_keys(spark):
    root = fresh_dir(spark, "r")
    sink, gold = make(spark, root, buckets=32)
    sink(spark.range(4000).select(F.col("id").cast("int"), F.lit(1).alias("seen"), F.concat(F.lit("g"), F.col("id") % 50).alias("g"), F.lit(1).alias("v"), F.lit(1).cast("decimal(9,2)").alias("w")), 0)
    new = spark.createDataFrame([(5, 2, "g5", 2, None), (77, 2, "g7", 3, None)], ROWS)
    sink.rows.write(new, 1)
    images = sink.images(1)
    assert len(buckets_read(images)) == 1 and buckets_read(images)[0] <= 2
    assert {(r.id, r.sign, r.v) for r in images.collect()} == {(5, -1, 1), (5, 1, 2), (77, -1, 1), (77, 1, 3)}
    touched = gold.state.current_of(spark.createDataFrame([("g5",)], "g string"), 0)
    assert buckets_read(touched) == [1]
    assert [(r.g, r.rows) for r in touched.collect()] == [("g5", 80)]
