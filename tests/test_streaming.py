from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from laketide.operators import quality as dq
from laketide.session import fresh_dir
from laketide.streaming import runners, windows
from laketide.streaming.batches import DeltaSink, GroupSink, UpsertSink

T0 = datetime(2024, 1, 1)
SCHEMA = "sensor int, at timestamp_ntz, v double"


def land(spark, path, readings):
    rows = [(s, T0 + timedelta(seconds=t), float(v)) for s, t, v in readings]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return windows.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "at")


def test_second_run_adds_only_new_files(spark):
    root = fresh_dir(spark, "s")

    def run():
        source = runners.file_stream(spark, f"{root}/in", "parquet", SCHEMA)
        runners.await_all([runners.append_to(source, f"{root}/out", f"{root}/ck")])
        return spark.read.parquet(f"{root}/out").count()

    land(spark, f"{root}/in", [(1, i, i) for i in range(50)])
    assert run() == 50
    land(spark, f"{root}/in", [(1, i, i) for i in range(50)])
    assert (run(), run()) == (100, 100)
    assert runners.active_streams(spark) == []


def test_closed_windows_are_written_once_and_late_rows_are_dropped(spark):
    root = fresh_dir(spark, "s")

    def run():
        agg = windows.tumbling(stream(spark, f"{root}/in"), "at", "1 minute", "2 minutes", ["sensor"], [F.count("*").alias("n")])
        runners.await_all([runners.append_to(agg, f"{root}/out", f"{root}/ck")])
        return {(r.window_start.minute, r.sensor): r.n for r in spark.read.parquet(f"{root}/out").collect()}

    land(spark, f"{root}/in", [(1, 5, 0), (1, 10, 0), (2, 30, 0)])
    assert run() == {}
    land(spark, f"{root}/in", [(1, 400, 0)])  # moves the watermark past the first minute
    assert run() == {(0, 1): 2, (0, 2): 1}
    land(spark, f"{root}/in", [(1, 7, 0), (1, 900, 0)])  # the first row is too late
    assert run() == {(0, 1): 2, (0, 2): 1, (6, 1): 1}


def test_update_mode_keeps_the_newest_row_of_a_group(spark):
    root = fresh_dir(spark, "s")
    for i in range(3):
        land(spark, f"{root}/in", [(1, 10 + i, i), (2, 10 + i, 10 * i)])
    agg = windows.keyed(stream(spark, f"{root}/in"), "at", "1 hour", ["sensor"], [F.count("*").alias("n"), F.max("v").alias("top")])
    sink = GroupSink(spark, f"{root}/out", agg.schema, ["sensor"])
    runners.await_all([runners.run_batches(agg, sink, f"{root}/ck", mode="update")])
    assert {(r.sensor, r.n, r.top) for r in sink.current().collect()} == {(1, 3, 2.0), (2, 3, 20.0)}


def test_alert_tiers(spark):
    df = spark.createDataFrame([(8.0,), (8.1,), (10.0,), (10.5,)], "v double")
    got = [(r.v, r.alert_severity) for r in windows.alerts(df, "v").collect()]
    assert got == [(8.1, "warning"), (10.0, "warning"), (10.5, "critical")]


# ---- micro-batch upsert ----------------------------------------------------------------------

REQUESTS = "id int, seen int, outcome string"


def upsert_sink(spark, root):
    rules = [dq.Rule("key", F.col("id").isNull()), dq.Rule("outcome", ~F.col("outcome").isin("passed", "rejected"))]
    return UpsertSink(spark, f"{root}/silver", spark.createDataFrame([], REQUESTS).schema, ["id"], ["seen"], rules)


def feed(spark, root, rows):
    spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run(spark, root, sink, checkpoint="ck"):
    source = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    runners.await_all([runners.run_batches(source, sink, f"{root}/{checkpoint}")])


def state(sink):
    return {r.id: (r.seen, r.outcome) for r in sink.current().collect()}


def test_upsert_over_runs_with_duplicates_and_bad_rows(spark):
    root = fresh_dir(spark, "s")
    sink = upsert_sink(spark, root)
    feed(spark, root, [(1, 1, "passed"), (5, 1, "passed")])
    run(spark, root, sink)
    feed(spark, root, [(5, 2, "rejected"), (101, 1, "passed"), (101, 9, "rejected"), (102, 1, "???"), (None, 1, "passed"), (103, 1, None)])
    run(spark, root, sink)
    want = {1: (1, "passed"), 5: (2, "rejected"), 101: (9, "rejected")}
    assert state(sink) == want
    log = [tuple(r)[:4] for r in sink.log.read().orderBy("number").collect()]
    assert log == [(0, 2, 2, 0), (1, 6, 3, 3)]
    assert sink.quarantine.read(sink.log.last()).count() == 3
    run(spark, root, sink)
    assert sink.log.read().count() == 2
    # every row delivered again by another query, whose batches are new work
    run(spark, root, upsert_sink(spark, root), checkpoint="another")
    assert state(sink) == want and sink.log.read().count() > 2


def test_new_rows_under_a_new_checkpoint_are_not_taken_for_a_replay(spark):
    root = fresh_dir(spark, "s")
    feed(spark, root, [(1, 1, "passed")])
    run(spark, root, upsert_sink(spark, root))
    feed(spark, root, [(2, 1, "passed")])
    sink = upsert_sink(spark, root)
    run(spark, root, sink, checkpoint="fresh")
    assert state(sink) == {1: (1, "passed"), 2: (1, "passed")}


def test_a_late_row_does_not_replace_a_newer_one(spark):
    root = fresh_dir(spark, "s")
    sink = upsert_sink(spark, root)
    for b, row in enumerate([(1, 5, "passed"), (1, 3, "rejected")]):
        sink(spark.createDataFrame([row], REQUESTS), b)
    assert state(sink) == {1: (5, "passed")}


def test_a_batch_that_died_before_its_log_row_is_replaced(spark):
    root = fresh_dir(spark, "s")
    sink = upsert_sink(spark, root)
    sink.rows.write(spark.createDataFrame([(9, 9, "passed"), (1, 9, "rejected")], REQUESTS), 0)  # half-done batch 0
    assert state(sink) == {}
    sink(spark.createDataFrame([(1, 1, "passed")], REQUESTS), 0)
    assert state(sink) == {1: (1, "passed")}


def test_compaction_keeps_the_state_and_stops_reading_old_batches(spark):
    root = fresh_dir(spark, "s")
    sink = upsert_sink(spark, root)
    for b, rows in enumerate([[(1, 1, "passed"), (2, 1, "passed")], [(2, 2, "rejected")], [(3, 1, "passed")]]):
        sink(spark.createDataFrame(rows, REQUESTS), b)
    before = state(sink)
    sink.compact()
    assert state(sink) == before
    sink(spark.createDataFrame([(1, 7, "rejected")], REQUESTS), 3)
    assert state(sink) == {**before, 1: (7, "rejected")}
    sink.compact()
    assert state(upsert_sink(spark, root)) == {**before, 1: (7, "rejected")}


def test_deltas_survive_a_restart_of_the_sink(spark):
    root = fresh_dir(spark, "s")
    keys = spark.createDataFrame([], "g string").schema

    def sink():
        return DeltaSink(spark, root, keys, F.col("m").cast("decimal(18,2)"))

    schema = "_change_type string, g string, m double"
    sink()(spark.createDataFrame([("insert", "a", 5.0), ("delete", "b", 1.0)], schema), 0)
    sink()(spark.createDataFrame([("update_preimage", "a", 5.0), ("update_postimage", "a", 7.5)], schema), 1)
    sink()(spark.createDataFrame([("insert", "a", 99.0)], schema), 1)  # a replay of batch 1
    start = spark.createDataFrame([("b", 10, 3)], "g string, total int, n int")
    got = {r.g: (float(r.total), r.n) for r in sink().applied_to(start, {"total": "delta", "n": "row_delta"}).collect()}
    assert got == {"a": (7.5, 1), "b": (9.0, 2)}


def test_failure_of_one_stream_is_raised(spark):
    root = fresh_dir(spark, "s")
    land(spark, f"{root}/in", [(1, 1, 1)])

    def broken(batch, batch_id):
        raise ValueError("broken batch")

    with pytest.raises(Exception, match="broken batch"):
        runners.await_all([runners.run_batches(stream(spark, f"{root}/in"), broken, f"{root}/ck")])


def test_running_streams_are_listed_and_stopped(spark):
    root = fresh_dir(spark, "s")
    land(spark, f"{root}/in", [(1, 1, 1)])
    source = runners.file_stream(spark, f"{root}/in", "parquet", SCHEMA)
    query = runners.append_to(source, f"{root}/out", f"{root}/ck", kind="processing_time", interval="1 second")
    query.processAllAvailable()
    assert runners.active_streams(spark) == [str(query.id)]
    runners.stop_all(spark)
    assert not query.isActive and spark.read.parquet(f"{root}/out").count() == 1


def test_new_columns_arrive_after_a_restart(spark):
    root = fresh_dir(spark, "s")

    def run():
        runners.await_all([runners.append_to(runners.evolving_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/ck")])

    spark.createDataFrame([(1,)], "id int").write.mode("append").parquet(f"{root}/in")
    run()
    spark.createDataFrame([(2, "x")], "id int, tag string").write.mode("append").parquet(f"{root}/in")
    run()
    out = spark.read.option("mergeSchema", True).parquet(f"{root}/out")
    assert sorted(tuple(r) for r in out.select("id", "tag").collect()) == [(1, None), (2, "x")]


def test_json_and_csv_landing_folders(spark):
    root = fresh_dir(spark, "s")
    rows = spark.createDataFrame([(1, 2.5), (2, 3.5)], "id int, v double")
    rows.write.json(f"{root}/json")
    rows.write.option("header", True).csv(f"{root}/csv")
    for fmt, options in (("json", {}), ("csv", {"header": True})):
        source = runners.file_stream(spark, f"{root}/{fmt}", fmt, rows.schema, **options)
        runners.await_all([runners.append_to(source, f"{root}/{fmt}_out", f"{root}/{fmt}_ck")])
        out = spark.read.parquet(f"{root}/{fmt}_out")
        assert sorted((r.id, r.v) for r in out.collect()) == [(1, 2.5), (2, 3.5)]
        assert out.where(F.col("_source_file").contains(f"/{fmt}/")).count() == 2


def test_empty_batches_are_logged(spark):
    root = fresh_dir(spark, "s")
    delta = DeltaSink(spark, f"{root}/d", spark.createDataFrame([], "g string").schema, F.col("m").cast("decimal(18,2)"))
    delta(spark.createDataFrame([], "_change_type string, g string, m double"), 0)
    group = GroupSink(spark, f"{root}/g", spark.createDataFrame([], "g string, n bigint").schema, ["g"])
    group(spark.createDataFrame([], "g string, n bigint"), 0)
    assert [r["rows_in"] for r in delta.log.read().unionByName(group.log.read()).collect()] == [0, 0]
    assert group.current().count() == 0
