from datetime import datetime

import pytest
from pyspark.sql import functions as F

from laketide.operators import changes, scd
from laketide.operators.incremental import IncrementalTable, same_state
from laketide.session import fresh_dir
from laketide.sources.snapshots import SnapshotTable


def ts(day):
    return datetime(2024, 1, day)


@pytest.fixture
def target(spark):
    rows = [(i, f"s{i}", float(i), ts(5)) for i in range(1, 7)] + [(None, "nokey", 0.0, ts(5))]
    return spark.createDataFrame(rows, "id int, status string, amount double, at timestamp_ntz")


def by_id(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_merge_updates_matches_and_inserts_the_rest(spark, target):
    source = spark.createDataFrame([(3, "new"), (4, "new"), (9001, "ins"), (9002, "ins"), (None, "nullkey")], "id int, status string")
    out = changes.merge(target, source, ["id"])
    assert out.schema == target.schema or [f.dataType for f in out.schema] == [f.dataType for f in target.schema]
    assert out.count() == target.count() + 3  # a NULL key never matches
    got = by_id(out.where("id IS NOT NULL"))
    assert got[3] == ("new", 3.0, ts(5)) and got[9001] == ("ins", None, None) and got[1] == ("s1", 1.0, ts(5))


def test_merge_only_newer_rows(spark, target):
    source = spark.createDataFrame([(1, "stale", 9.0, ts(1)), (2, "fresh", 9.0, ts(9)), (8, "x", 1.0, ts(1))], target.schema)
    got = by_id(changes.merge(target, source, ["id"], when_matched="s.at > t.at"))
    assert got[1][0] == "s1" and got[2][0] == "fresh" and got[8][0] == "x"


def test_merge_with_delete_clause(spark, target):
    source = spark.createDataFrame([(1, "a", "DELETE"), (2, "b", "UPDATE"), (50, "c", "DELETE"), (51, "d", "INSERT"), (3, "e", None)], "id int, status string, op string")
    got = by_id(changes.merge(target, source, ["id"], delete_when="s.op = 'DELETE'"))
    assert 1 not in got and 50 not in got and got[2][0] == "b" and got[51][0] == "d" and got[3][0] == "e"


def test_merge_clauses_can_be_switched_off(spark, target):
    source = spark.createDataFrame([(1, "a"), (70, "b")], "id int, status string")
    assert 70 not in by_id(changes.merge(target, source, ["id"], insert=[]))
    assert by_id(changes.merge(target, source, ["id"], update=[]))[1][0] == "s1"


def test_merge_with_duplicate_source_keys(spark, target):
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id int, status string, seq int")
    with pytest.raises(changes.DuplicateSourceKey):
        changes.merge(target, source, ["id"])
    assert by_id(changes.merge(target, source, ["id"], dedup_by=["seq"]))[1][0] == "new"


def test_update_and_delete_keep_undecided_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 15), (3, None)], "id int, v int")
    assert by_id(changes.update_where(df, F.col("v") > 10, {"v": F.lit(0)})) == {1: (5,), 2: (0,), 3: (None,)}
    assert by_id(changes.delete_where(df, F.col("v") > 10)) == {1: (5,), 3: (None,)}


def test_change_feed_and_deltas(spark, rows):
    before = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 30.0), (4, None, None)], "id int, g string, m double")
    after = spark.createDataFrame([(1, "a", 10.0), (2, "b", 25.0), (4, "c", None), (5, "a", 1.0)], "id int, g string, m double")
    feed = changes.change_feed(before, after, ["id"], version=7)
    kinds = sorted((r._change_type, r.id) for r in feed.collect())
    assert kinds == [("delete", 3), ("insert", 5), ("update_postimage", 2), ("update_postimage", 4), ("update_preimage", 2), ("update_preimage", 4)]
    assert {r._commit_version for r in feed.collect()} == {7}

    def agg(df):
        return df.groupBy("g").agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("total"), F.count("*").alias("n"))

    rebuilt = changes.recompute_affected(
        agg(before), feed, after, ["g"], [F.sum(F.coalesce("m", F.lit(0.0))).alias("total"), F.count("*").alias("n")]
    )
    assert rows(rebuilt.where("g IS NOT NULL")) == rows(agg(after).where("g IS NOT NULL"))


def test_recompute_drops_a_group_without_rows(spark):
    before = spark.createDataFrame([(1, "gone", 1.0), (2, "stays", 2.0)], "id int, g string, m double")
    after = before.where("id = 2")
    feed = changes.change_feed(before, after, ["id"])
    aggs = [F.sum("m").alias("total")]
    out = changes.recompute_affected(before.groupBy("g").agg(*aggs), feed, after, ["g"], aggs)
    assert [(r.g, r.total) for r in out.collect()] == [("stays", 2.0)]


# ---- SCD2 ----------------------------------------------------------------------------------

INITIAL = [(1, "passed", 10), (2, "passed", 20), (3, "passed", 30), (4, "flagged", 40), (5, "rejected", 50), (6, "passed", 60)]
DAY2 = [(2, "rejected", 40), (3, "flagged", 999), (7, "passed", 25)]
DAY3 = [(2, "rejected", 500), (8, "flagged", 15)]
SCHEMA = "request_id int, outcome string, minutes int"


@pytest.mark.parametrize("by_hash", [False, True])
def test_scd2_history(spark, by_hash):
    tracked, keys = ["outcome", "minutes"], ["request_id"]
    at = [F.lit(ts(d)).cast("timestamp_ntz") for d in (1, 2, 3)]
    day1, day2, day3 = (spark.createDataFrame(r, SCHEMA) for r in (INITIAL, DAY2, DAY3))
    merge = scd.merge_by_hash if by_hash else scd.merge_by_values
    dim = scd.initial(scd.with_hash(day1, tracked) if by_hash else day1, at[0])
    dim = merge(dim, day2, keys, tracked, at[1])
    assert (dim.count(), scd.current(dim).count()) == (9, 7)
    dim = merge(dim, day3, keys, tracked, at[2]).cache()
    assert (dim.count(), scd.current(dim).count(), dim.where("NOT is_current").count()) == (11, 8, 3)
    history = [(r.version, r.outcome, r.minutes, r.is_current, r.valid_to) for r in dim.where("request_id = 2").orderBy("version").collect()]
    assert history == [(1, "passed", 20, False, ts(2)), (2, "rejected", 40, False, ts(3)), (3, "rejected", 500, True, None)]
    assert scd.as_of(dim, F.lit(datetime(2024, 1, 2, 12)).cast("timestamp_ntz")).count() == 7
    again = merge(dim, day3, keys, tracked, at[2])
    assert again.count() == 11  # the same changes a second time open no version


def test_scd2_sees_null_changes_and_field_shifts(spark):
    at = F.lit(ts(1)).cast("timestamp_ntz")
    dim = scd.initial(scd.with_hash(spark.createDataFrame([(1, "a", None), (2, None, "a")], "id int, x string, y string"), ["x", "y"]), at)
    change = spark.createDataFrame([(1, None, "a"), (2, None, "a")], "id int, x string, y string")
    out = scd.merge_by_hash(dim, change, ["id"], ["x", "y"], at)
    assert sorted((r.id, r.version) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


# ---- stored versions and loads ------------------------------------------------------------------


def test_snapshots_travel_and_restore(spark, rows):
    table = SnapshotTable(spark, fresh_dir(spark, "t"))
    with pytest.raises(ValueError):
        table.read()
    for day, n in ((1, 3), (2, 5), (3, 1)):
        table.commit(spark.range(n), "WRITE", ts(day))
    assert [table.read(v).count() for v in (0, 1, 2)] == [3, 5, 1] and table.read().count() == 1
    assert table.read_as_of(datetime(2024, 1, 2, 23)).count() == 5
    with pytest.raises(ValueError):
        table.read_as_of(datetime(2023, 12, 31))
    with pytest.raises(ValueError):
        table.read(3)
    assert table.restore(1, ts(4)) == 3 and rows(table.read()) == rows(spark.range(5))
    assert [(r.version, r.operation, r.rows_written) for r in table.history().orderBy("version").collect()] == [
        (0, "WRITE", 3), (1, "WRITE", 5), (2, "WRITE", 1), (3, "RESTORE 1", 5)
    ]


def test_a_commit_that_died_is_invisible_and_replaced(spark):
    table = SnapshotTable(spark, fresh_dir(spark, "t"))
    table.commit(spark.range(2), "WRITE", ts(1))
    spark.range(99).write.parquet(f"{table.path}/version=1")  # written, never logged
    assert table.latest_version() == 0 and table.read().count() == 2
    table.commit(spark.range(4), "WRITE", ts(2))
    assert table.read().count() == 4


def test_incremental_loads_move_the_mark_and_skip_repeats(spark):
    table = IncrementalTable(spark, fresh_dir(spark, "t"))
    assert table.full_load(spark.range(8), "r1", "id", ts(1)) == 8
    spark.range(500).write.parquet(f"{table.path}/runs/run=r2")  # a run that died before its log row
    assert table.read().count() == 8
    assert table.incremental_load(spark.range(10), "r2", "id", ts(2)) == 2
    assert table.incremental_load(spark.range(10), "r2", "id", ts(2)) == 0
    assert table.incremental_load(spark.range(10), "r3", "id", ts(3)) == 0
    assert table.high_mark() == 9 and table.read().count() == 10
    assert same_state(spark.range(10), table.read()).first().same
    table.full_load(spark.range(4), "r4", "id", ts(4))
    assert table.read().count() == 4


def test_empty_commits_and_loads(spark):
    table = SnapshotTable(spark, fresh_dir(spark, "t"))
    table.commit(spark.range(5).where("false"), "WRITE", ts(1))
    assert table.read().count() == 0 and table.history().first().rows_written == 0
    loads = IncrementalTable(spark, fresh_dir(spark, "t"))
    assert loads.full_load(spark.createDataFrame([], "id bigint"), "r1", "id", ts(1)) == 0
    assert loads.high_mark() is None and loads.read().count() == 0
    assert loads.incremental_load(spark.range(3), "r2", "id", ts(2)) == 3 and loads.read().count() == 3
    empty = spark.createDataFrame([], "id int, status string")
    some = spark.createDataFrame([(1, "a")], "id int, status string")
    assert changes.merge(some, empty, ["id"]).count() == 1 and changes.merge(empty, some, ["id"]).count() == 1
    assert changes.change_feed(empty, some, ["id"]).first()._change_type == "insert"


def test_scd_refuses_or_dedups_several_changes_of_one_key(spark):
    dim = scd.initial(spark.createDataFrame([(1, "a")], "k int, v string"), F.lit("2024-01-01").cast("timestamp_ntz"))
    changes_ = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 1), (2, "y", 2)], "k int, v string, t int")
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    with pytest.raises(changes.DuplicateSourceKey):
        scd.merge_by_values(dim, changes_, ["k"], ["v"], at)
    out = scd.merge_by_values(dim, changes_, ["k"], ["v"], at, dedup_by=["t"])
    assert sorted((r.k, r.v, r.version, r.is_current) for r in out.collect()) == [(1, "a", 1, False), (1, "c", 2, True), (2, "y", 1, True)]


def test_runs_with_equal_times_count_in_their_order(spark):
    from datetime import datetime

    from laketide.operators.incremental import IncrementalTable
    from laketide.session import fresh_dir

    table = IncrementalTable(spark, fresh_dir(spark, "equal_times"))
    at = datetime(2024, 1, 1)
    table.full_load(spark.range(50).toDF("id"), "r9", "id", at)
    table.incremental_load(spark.range(100).toDF("id"), "r10", "id", at)
    assert table.read().count() == 100


def test_loads_are_read_by_a_range_of_partitions(spark):
    path = fresh_dir(spark, "many")
    table = IncrementalTable(spark, path)
    at = datetime(2024, 1, 1)
    table.full_load(spark.range(5), "f1", "id", at)
    for i in range(3):
        table.incremental_load(spark.range(5 + 5 * (i + 1)), f"a{i}", "id", at)
    table.full_load(spark.range(100, 103), "f2", "id", at)
    for i in range(3):
        table.incremental_load(spark.range(103 + i + 1), f"b{i}", "id", at)
    spark.range(7).write.parquet(f"{path}/loads/__load=9")  # a run that died before its log row
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = table.read()._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "__load" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r["id"] for r in table.read().collect()) == list(range(100, 106))
    assert table.incremental_load(spark.range(110), "next", "id", at) == 4  # takes the dead run's number
    assert table.read().count() == 10 and table.high_mark() == 109
