"""Layout by several columns, chained stream layers, restarts, drift in one scan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from laketide.operators import drift
from laketide.operators import quality as dq
from laketide.plans import q_sources
from laketide.session import fresh_dir
from laketide.sources import layout, writers
from laketide.sources.evolution import GrowingTable
from laketide.streaming import runners
from laketide.streaming.layers import Layer, StreamLayers

# ---- z-order ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    """Two independent columns, a text and NULLs; one value of ``a`` fills a third of the rows."""
    i = F.col("id")
    a = F.when(i % 3 == 0, 500).otherwise((i * 7919) % 1000)
    return spark.range(20_000).select(
        i, a.cast("int").alias("a"), F.when(i % 50 != 7, (i * 104_729) % 1000).alias("b"), F.concat(F.lit("k"), F.lpad(((i * 31) % 700).cast("string"), 4, "0")).alias("t"),
        F.timestamp_add("MINUTE", ((i * 17) % 5000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
    )


@pytest.mark.parametrize("parts", [[], [None, None], [None, 7, 7, 9, 3], list(range(300))])
def test_zorder_layout_gathers_no_column(spark, tmp_path, monkeypatch, parts):
    """The bounds of the filter are exact, but no task gets the values of a whole column, as ``percentile`` needs them."""
    day = datetime(1997, 1, 5)
    lines = spark.createDataFrame([(i, 1, p, day, 1.0) for i, p in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp_ntz, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    low, high = lines.agg(F.percentile("l_partkey", 0.5), F.percentile("l_partkey", 0.51)).first()
    within = 0 if low is None else lines.where(F.col("l_partkey").between(F.ceil(F.lit(low)), F.floor(F.lit(high)))).count()
    monkeypatch.setattr(F, "percentile", None)
    got = q_sources.zorder_layout(spark, str(tmp_path)).collect()
    assert [(r.column_name, r.rows) for r in got] == [("l_partkey", within), ("l_shipdate", len(parts))]


def test_compaction_moves_no_row_between_tasks(spark):
    """Each small file goes whole into one large file, so a task reads packed files, not unpacked rows of all."""
    small, large = (fresh_dir(spark, n) for n in ("small", "large"))
    spark.range(80_000).repartitionByRange(8, "id").write.parquet(small)
    size = writers.file_counts(spark, small).first().bytes
    origin = spark.read.parquet(small).select("id", F.col("_metadata.file_path").alias("was"))
    writers.compact(spark, small, large, target_bytes=size // 2)
    now = spark.read.parquet(large).select("id", F.col("_metadata.file_path").alias("now"))
    assert 1 < writers.file_counts(spark, large).first().files < 8
    both = origin.join(now, "id")
    assert both.count() == 80_000 and both.select("was", "now").distinct().count() == 8


def test_filters_on_either_column_skip_files(spark, points):
    flat, woven = fresh_dir(spark, "flat"), fresh_dir(spark, "woven")
    writers.cluster(points, flat, ["a", "b"], files=32)
    assert layout.zorder(points, woven, ["a", "b"], files=32) == 32
    assert spark.read.parquet(woven).exceptAll(points).isEmpty() and spark.read.parquet(woven).count() == 20_000
    touched = {}
    for name, path in (("flat", flat), ("woven", woven)):
        ranges = layout.file_ranges(spark, path, ["a", "b"])
        for c in ("a", "b"):
            r = layout.files_touched(ranges, c, 100, 120).first()
            touched[name, c] = r["touched"] / r["files"]
    # the sort keeps the second column in nearly every file, the layout skips by both
    assert touched["woven", "b"] < 0.8 * touched["flat", "b"] and touched["woven", "a"] < 0.5, touched
    sizes = [r["rows"] for r in layout.file_ranges(spark, woven, ["a"]).collect()]
    assert max(sizes) < 6 * 20_000 / 32  # the value with a third of the rows is spread


def test_texts_times_and_nulls_have_ranks(spark, points):
    path = fresh_dir(spark, "woven")
    layout.zorder(points, path, ["t", "at", "b"], files=8)
    assert spark.read.parquet(path).exceptAll(points).isEmpty()
    ranks = points.select(*[r.alias(f"r{i}") for i, r in enumerate(layout.range_ranks(points, ["t", "at", "b"], 3))], "t", "at", "b")
    for i, c in enumerate(("t", "at", "b")):
        ends = ranks.groupBy(f"r{i}").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy(f"r{i}").where("lo IS NOT NULL").collect()
        assert len(ends) >= 7 and all(x["hi"] < y["lo"] for x, y in zip(ends, ends[1:], strict=False))
    assert {r[0] for r in ranks.where("b IS NULL").select("r2").collect()} == {0}
    with pytest.raises(TypeError):
        layout.number_of(points.withColumn("m", F.array("a")), "m")


def test_bits_are_interleaved(spark):
    df = spark.createDataFrame([(0b101, 0b011)], "x int, y int")
    assert df.select(layout.interleaved([F.col("x"), F.col("y")], 3)).first()[0] == 0b011011
    assert layout.file_count(spark.range(0)) == 1
    assert layout.file_count(spark.range(100_000).select("id", F.repeat(F.lit("x"), 100).alias("pad")), 1_000_000) >= 3
    path = fresh_dir(spark, "woven")
    layout.zorder(spark.createDataFrame([], "x int, y int"), path, ["x", "y"])
    assert spark.read.schema("x int, y int").parquet(path).count() == 0


# ---- drift --------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_rows", [1_000_000, 30])
def test_ks_of_many_features_in_one_scan(spark, chunk_rows):
    i = F.col("id")
    df = spark.range(3000).select((i % 5 < 2).alias("late"), ((i * 37) % 211).alias("p"), F.when(i % 5 < 2, (i * 13) % 97 + 20).otherwise((i * 13) % 97).alias("q"), F.when(i % 11 == 0, i % 2).alias("r"))
    counts = drift.value_counts(df, F.col("late"), ["p", "q", "r"])
    got = {r["feature"]: (r["ks_statistic"], r["ks_pvalue"]) for r in drift.ks_of(counts, chunk_rows=chunk_rows).collect()}
    for f in ("p", "q", "r"):
        want = drift.ks(df, F.col("late"), f).first()
        assert got[f] == pytest.approx((want["ks_statistic"], want["ks_pvalue"]))
    bins = {tuple(r) for r in drift.histograms_of(counts).collect()}
    assert bins == {tuple(r) for r in drift.histograms(df, F.col("late"), ["p", "q", "r"]).collect()}


def test_a_feature_of_one_side_has_no_ks(spark):
    df = spark.createDataFrame([(True, 1.0, 1.0), (True, 2.0, None), (False, None, 3.0)], "late boolean, x double, y double")
    got = {r["feature"]: r["ks_statistic"] for r in drift.ks_of(drift.value_counts(df, F.col("late"), ["x", "y"])).collect()}
    assert got == {"x": None, "y": 1.0}


def test_report_scans_its_source_once(spark):
    path = fresh_dir(spark, "source")
    spark.range(100).select((F.col("id") % 2 == 0).alias("late"), "id", (F.col("id") * 2).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    before = spark.sparkContext.statusTracker()
    report = drift.drift_report(df, F.col("late"), ["id", "v"])
    text = report._jdf.queryExecution().toString()
    assert path not in text and before is not None  # only the stored counts are read from here on
    assert {r["feature"] for r in report.collect()} == {"id", "v"}


def test_history_keeps_one_report_a_run(spark):
    history = drift.DriftHistory(spark, fresh_dir(spark, "history"))
    rows = lambda *flags: spark.createDataFrame([(f, d) for f, d in zip("ab", flags, strict=True)], "feature string, drift_detected boolean")
    for day, flags in ((1, (True, False)), (2, (False, False)), (3, (True, True)), (3, (True, True)), (4, (True, False))):
        history.record(rows(*flags), f"run/{day}", f"v{day}", datetime(2024, 1, day))
    assert history.read().count() == 8
    got = {r["feature"]: (r["checked_at"].day, r["drift_detected"], r["runs_in_drift"]) for r in history.since_drift().collect()}
    assert got == {"a": (4, True, 2), "b": (4, False, 0)}


# ---- layers ---------------------------------------------------------------------------------------


def land(spark, root, rows):
    spark.createDataFrame(rows, "id int, v int").coalesce(1).write.mode("append").parquet(f"{root}/in")


def layers(spark, root, broken=False):
    def silver(bronze):
        return bronze.withColumn("w", F.col("v") * 10) if not broken else bronze.withColumn("w", F.raise_error(F.lit("broken layer")))

    return StreamLayers(
        spark,
        root,
        {"landing": lambda s: runners.table_stream(s, f"{root}/in", "id int, v int")},
        [
            Layer("gold", ["silver", "bronze"], lambda s, b: s.select("id").unionByName(b.select("id"))),
            Layer("silver", ["bronze"], silver, [dq.Rule("v", F.col("v").isNull()), dq.Rule("big", F.col("v") > 5, severity="warning")]),
            Layer("bronze", ["landing"], lambda x: x),
        ],
    )


def test_layers_follow_each_other_and_continue(spark, rows):
    root = fresh_dir(spark, "layers")
    land(spark, root, [(1, 1), (2, None), (3, 9)])
    first = layers(spark, root)
    assert [x.name for x in first.layers] == ["bronze", "silver", "gold"]
    first.run()
    counts = {r["layer"]: r["rows"] for r in first.counts().collect()}
    assert counts == {"bronze": 3, "silver": 2, "silver_rejected": 1, "gold": 5}
    assert [r["_failed_rules"] for r in first.table("silver_rejected").collect()] == ["[v]"]
    land(spark, root, [(4, 4)])
    again = layers(spark, root)
    assert again.run() == {"bronze": 1, "silver": 1, "gold": 2}
    assert {r["w"] for r in again.table("silver").collect()} == {10, 90, 40}
    assert again.run() == {"bronze": 0, "silver": 0, "gold": 0}


def test_a_layer_that_fails_stops_the_later_ones_and_is_repeated(spark):
    root = fresh_dir(spark, "layers")
    land(spark, root, [(1, 1)])
    with pytest.raises(Exception, match="broken layer"):
        layers(spark, root, broken=True).run()
    healed = layers(spark, root)
    healed.run()
    assert {r["layer"]: r["rows"] for r in healed.counts().collect()} == {"bronze": 1, "silver": 1, "silver_rejected": 0, "gold": 2}


@pytest.mark.parametrize(
    "declared",
    [
        [Layer("a", ["b"], None), Layer("b", ["a"], None)],
        [Layer("a", ["nowhere"], None)],
        [Layer("a", ["in"], None), Layer("a", ["in"], None)],
        [Layer("a", ["in"], None, sink=print), Layer("b", ["a"], None)],
    ],
)
def test_wrong_declarations_are_refused(spark, declared):
    with pytest.raises(ValueError):
        StreamLayers(spark, "x", {"in": None}, declared)


# ---- one restart ----------------------------------------------------------------------------------


def changing(spark, root, changes):
    """A reader that sees another column come after each time it looked, ``changes`` times."""
    looks = []

    def reader():
        stream = runners.evolving_stream(spark, f"{root}/in", maxFilesPerTrigger=1)
        looks.append(1)
        if len(looks) <= changes:
            spark.createDataFrame([(10 + len(looks), "x")], f"id int, extra{len(looks)} string").coalesce(1).write.mode("append").parquet(f"{root}/in")
        return stream

    return reader


def test_one_schema_change_restarts_the_stream(spark):
    root = fresh_dir(spark, "restart")
    spark.createDataFrame([(1,)], "id int").write.mode("append").parquet(f"{root}/in")
    out = GrowingTable(spark, f"{root}/out", ["batch"])
    process = lambda df, b: out.append(df.withColumn("batch", F.lit(b)), overwrite_partitions=True)
    assert runners.run_evolving(spark, f"{root}/in", process, f"{root}/ck", reader=changing(spark, root, 1)) == 1
    assert sorted((r["id"], r["extra1"]) for r in out.read().collect()) == [(1, None), (11, "x")]
    assert runners.run_evolving(spark, f"{root}/in", process, f"{root}/ck") == 0
    assert out.read().count() == 2


def test_a_second_failure_is_raised(spark):
    root = fresh_dir(spark, "restart")
    spark.createDataFrame([(1,)], "id int").write.mode("append").parquet(f"{root}/in")
    with pytest.raises(Exception, match="SchemaChanged"):
        runners.run_evolving(spark, f"{root}/in", lambda df, b: None, f"{root}/ck", reader=changing(spark, root, 2))

    def broken(df, b):
        raise ValueError("another failure")

    with pytest.raises(Exception, match="another failure"):
        runners.run_evolving(spark, f"{root}/in", broken, f"{root}/ck2", restarts=3)


# ---- daily profiles -------------------------------------------------------------------------------


def test_profiles_of_several_columns(spark):
    from laketide.operators import monitoring as mon

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    df = spark.range(900).select(day.alias("day"), F.when(F.col("id") % 7 > 0, (F.col("id") * 13) % 101 + 40 * (F.col("id") % 3)).alias("a"), (F.col("id") % 10).alias("b"))
    edges = mon.profile_edges(df, ["a", "b"])
    profiles = mon.daily_profiles(df, F.col("day"), ["a", "b"], edges)
    got = {(r["column"], r["day"].day): r for r in mon.profile_drift(profiles).collect()}
    assert set(got) == {(c, d) for c in "ab" for d in (1, 2, 3)}
    for (c, d), r in got.items():
        x = df.where(F.dayofmonth("day") == d).agg(F.count("*").alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.count(c).alias("k")).first()
        assert (r["rows"], r["lo"]) == (x["n"], x["lo"]) and r["mean"] == pytest.approx(x["m"], abs=1e-5) and r["deviation"] == pytest.approx(x["s"], abs=1e-5)
        assert r["null_share"] == pytest.approx(1 - x["k"] / x["n"], abs=1e-6)
        assert (r["js_distance"] is None) == (r["mean_move"] is None) == (d == 1)
        if d > 1:
            single = mon.daily_drift(df, F.col("day"), c).where(F.dayofmonth("day") == d).first()["js_distance"]
            assert r["js_distance"] == pytest.approx(single)
    text = profiles._jdf.queryExecution().executedPlan().toString()
    assert text.count("Range (0, 900") == 1
    with pytest.raises(ValueError):
        mon.daily_profiles(df, F.col("day"), ["a", "zzz"], edges)
    again = mon.daily_profiles(df.withColumn("a", F.lit(10_000)), F.col("day"), ["a"], edges)  # beyond the edges
    assert {r["bin"] for r in again.collect()} == {9}
