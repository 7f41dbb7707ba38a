"""Rescue, growing schemas, merges that grow, feeds over versions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.operators import changes
from laketide.session import fresh_dir
from laketide.sources import rescue
from laketide.sources.evolution import GrowingTable, IncompatibleTypes, common_schema, fit_to
from laketide.sources.snapshots import SnapshotTable
from laketide.streaming import runners


def ddl(text):
    return T.StructType.fromDDL(text)


# ---- rescue -----------------------------------------------------------------------------------

NESTED = "a bigint, b string, c struct<p: bigint>, arr array<struct<p: bigint>>, m map<string, int>"


@pytest.mark.parametrize(
    "line, typed, rescued",
    [
        ('{"a":1,"b":"x"}', (1, "x"), None),
        ('{"a":1,"new":[1,{"z":2}]}', (1, None), '{"new":[1,{"z":2}]}'),
        ('{"a":"no","b":5}', (None, "5"), '{"a":"no"}'),
        ('{"a":1.5,"zz":null}', (None, None), '{"zz":null,"a":1.5}'),
        ('{"c":{"p":1,"q":2}}', (None, None), '{"c":{"q":2}}'),
        ('{"c":{"p":"bad"}}', (None, None), '{"c":{"p":"bad"}}'),
        ('{"c":7}', (None, None), '{"c":7}'),
        ('{"arr":[{"p":1},{"p":2,"w":0}]}', (None, None), '{"arr":[{"p":1},{"p":2,"w":0}]}'),
        ('{"m":{"x":1,"y":"z"}}', (None, None), '{"m":{"x":1,"y":"z"}}'),
        ('{"m":{"x":1}, "c":null, "arr":[]}', (None, None), None),
        ("{}", (None, None), None),
        ("[1]", (None, None), '{"_corrupt_record":"[1]"}'),
        ("broken {", (None, None), '{"_corrupt_record":"broken {"}'),
        ('{"a":1,"a":2}', (None, None), '{"_corrupt_record":"{\\"a\\":1,\\"a\\":2}"}'),
    ],
)
def test_json_keeps_what_does_not_fit(spark, line, typed, rescued):
    df = spark.createDataFrame([(line, 9)], "value string, n int")
    got = rescue.rescue_json(df, NESTED).first()
    assert ((got["a"], got["b"]), got["_rescued_data"], got["n"]) == (typed, rescued, 9)


def test_json_blank_lines_are_skipped(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), ('{"a":3}',)], "value string")
    assert [r["a"] for r in rescue.rescue_json(df, "a int").collect()] == [3]


def csv_files(tmp_path):
    (tmp_path / "1.csv").write_text('a,b,when\n1,"x, ""y""",2024-01-01\nbad,z,nodate\n\n3,,\n4,q\n5,q,2024-01-02,more\n')
    (tmp_path / "2.csv").write_text("when,extra,a,a\n2024-02-01,E,7,8\n,,9,\n")
    (tmp_path / "3.csv").write_text("a,b,when\n")


CSV_ROWS = [
    (None, "z", None, '{"a":"bad","when":"nodate"}'),
    (1, 'x, "y"', "2024-01-01", None),
    (3, None, None, None),
    (4, "q", None, '{"_corrupt_record":"4,q"}'),
    (5, "q", "2024-01-02", '{"_corrupt_record":"5,q,2024-01-02,more"}'),
    (7, None, "2024-02-01", '{"extra":"E","a__2":"8"}'),
    (9, None, None, None),
]


def rows_of(df):
    rows = [(r["a"], r["b"], r["when"] and str(r["when"]), r["_rescued_data"]) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_csv_follows_each_files_header(spark, tmp_path):
    csv_files(tmp_path)
    assert rows_of(rescue.read_csv_rescued(spark, str(tmp_path), "a bigint, b string, when date")) == CSV_ROWS


def test_csv_header_of_a_file_in_several_splits(spark, tmp_path):
    (tmp_path / "1.csv").write_text("b,a,new\n" + "".join(f"t{i},{i},n{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = rescue.read_csv_rescued(spark, str(tmp_path), "a int, b string")
        assert df.rdd.getNumPartitions() > 3
        got = {(r["a"], r["b"], r["_rescued_data"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(i, f"t{i}", f'{{"new":"n{i}"}}') for i in range(3000)}


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    csv_files(tmp_path / "in")
    held = []
    each = rescue.rescued_batches(lambda df, _: held.extend(rows_of(df)), "a bigint, b string, when date")
    for _ in range(2):  # the second run finds nothing new
        lines = rescue.stream_csv_lines(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
        runners.await_all([runners.run_batches(lines, each, str(tmp_path / "ck"))])
    assert sorted(held, key=lambda r: (r[0] is not None, r[0] or 0)) == CSV_ROWS


# ---- common schemas ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("x int", "x bigint", "x bigint"),
        ("x smallint", "x decimal(5,2)", "x decimal(7,2)"),
        ("x decimal(10,2)", "x decimal(8,4)", "x decimal(12,4)"),
        ("x int", "x double", "x double"),
        ("x float", "x int", "x double"),
        ("x date", "x timestamp_ntz", "x timestamp_ntz"),
        ("x void", "x string", "x string"),
        ("x int, y string", "z int, X bigint", "x bigint, y string, z int"),
        ("s struct<a: int>", "s struct<b: string, a: bigint>", "s struct<a: bigint, b: string>"),
        ("l array<int>", "l array<bigint>", "l array<bigint>"),
    ],
)
def test_common_schema(a, b, want):
    assert common_schema(ddl(a), ddl(b)).simpleString() == ddl(want).simpleString()


@pytest.mark.parametrize("a, b", [("x bigint", "x double"), ("x string", "x int"), ("x decimal(38,2)", "x decimal(38,10)"), ("x array<int>", "x int"), ("s struct<a: int>", "s struct<a: string>"), ("x timestamp", "x date")])
def test_what_cannot_widen_is_refused(a, b):
    with pytest.raises(IncompatibleTypes):
        common_schema(ddl(a), ddl(b))


def test_nested_values_are_widened(spark):
    df = spark.createDataFrame([(((1, None)), [(5,)], {"k": 2}), (None, None, None)], "s struct<a: int, b: string>, l array<struct<p: int>>, m map<string, int>")
    wide = ddl("s struct<a: bigint, b: string, c: double>, l array<struct<p: bigint, q: string>>, m map<string, bigint>, n string")
    got = fit_to(df, wide)
    assert got.schema.simpleString() == wide.simpleString()
    first, second = got.collect()
    assert first.s.a == 1 and first.s.c is None and first.l[0].p == 5 and first.l[0].q is None and first.m == {"k": 2} and first.n is None
    assert second.s is None and second.l is None


def test_a_table_takes_wider_batches_and_refuses_others(spark):
    t = GrowingTable(spark, fresh_dir(spark, "grow"), ["day"])
    t.append(spark.createDataFrame([(1, 5, 1)], "id int, v int, day int"))
    t.append(spark.createDataFrame([(2, 3_000_000_000, "n", 2)], "id bigint, v bigint, note string, day int"))
    t.append(spark.createDataFrame([(3, 7, 1)], "id int, v int, day int"))
    with pytest.raises(IncompatibleTypes):
        t.append(spark.createDataFrame([("x", 1)], "id string, day int"))
    assert {tuple(r) for r in t.read().select("id", "v", "note", "day").collect()} == {(1, 5, None, 1), (2, 3_000_000_000, "n", 2), (3, 7, None, 1)}
    t.append(spark.createDataFrame([(4, 8, 1)], "id int, v int, day int"), overwrite_partitions=True)
    assert {r["id"] for r in t.read().collect()} == {2, 4}
    assert "PartitionFilters: [isnotnull(day" in t.read().where("day = 2")._jdf.queryExecution().toString()


# ---- merge ------------------------------------------------------------------------------------


def test_merge_refuses_or_adds_unknown_columns(spark):
    target = spark.createDataFrame([(1, 10, (1,)), (2, 20, (2,))], "id int, v int, s struct<a: int>")
    source = spark.createDataFrame([(2, 3_000_000_000, (5, "x"), "n"), (3, 1, (6, "y"), "m")], "ID bigint, v bigint, s struct<a: int, b: string>, note string")
    with pytest.raises(changes.UnknownColumns):
        changes.merge(target, source, ["id"])
    got = changes.merge(target, source, ["id"], evolve=True)
    assert got.schema.simpleString() == "struct<id:bigint,v:bigint,s:struct<a:int,b:string>,note:string>"
    rows = {(r.id, r.v, r.s.a, r.s.b, r.note) for r in got.collect()}
    assert rows == {(1, 10, 1, None, None), (2, 3_000_000_000, 5, "x", "n"), (3, 1, 6, "y", "m")}


def test_merge_keeps_columns_the_source_lacks(spark):
    target = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, v int, kept string")
    source = spark.createDataFrame([(2, 7, "D"), (3, 8, "I")], "id int, extra int, op string")
    got = changes.merge(target, source, ["id"], evolve=True, ignore=["op"], delete_when="s.op = 'X'")
    assert {tuple(r) for r in got.select("id", "v", "kept", "extra").collect()} == {(1, 10, "a", None), (2, 20, "b", 7), (3, None, None, 8)}
    with pytest.raises(IncompatibleTypes):
        changes.merge(target, spark.createDataFrame([(1, "x")], "id int, v string"), ["id"], evolve=True)


# ---- feeds ------------------------------------------------------------------------------------


def test_feed_with_null_keys_and_new_columns(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x", None), (None, "n", 5), (4, "w", 6)], "id bigint, v string, extra int")
    got = {(r._change_type, r.id, r.v, r.extra) for r in changes.change_feed(a, b, ["id"]).collect()}
    assert got == {("update_preimage", None, "n", None), ("update_postimage", None, "n", 5), ("delete", 3, "z", None), ("insert", 4, "w", 6)}


def test_changes_over_versions(spark):
    t = SnapshotTable(spark, fresh_dir(spark, "versions"), keys=["id"])
    at = [datetime(2024, 1, d) for d in range(1, 6)]
    t.commit(spark.createDataFrame([(1, 1), (2, 2), (None, 0)], "id int, v int"), "WRITE", at[0])
    t.commit(spark.createDataFrame([(1, 5), (3, 3), (None, 0)], "id int, v int"), "MERGE", at[1])
    t.commit(spark.createDataFrame([(1, 1, "n"), (2, 2, None), (4, 4, None), (None, 9, None)], "id int, v bigint, note string"), "MERGE", at[2])
    t.commit(spark.createDataFrame([(2, 2, None), (None, 9, None)], "id int, v bigint, note string"), "DELETE", at[3])

    def rows(df):
        return sorted(((r._change_type, r._commit_version, r.id, r.v, r.note) for r in df.collect()), key=repr)

    assert {(r[0], r[1]) for r in rows(t.changes_between(0, 0))} == {("insert", 0)}
    assert rows(t.changes_between(3, 3)) == [("delete", 3, 1, 1, "n"), ("delete", 3, 4, 4, None)]
    # over 1..2: key 1 came back but for its note, 2 was deleted and came back, 3 came and went
    assert rows(t.changes_between(1, 2, net=True)) == sorted(
        [("update_preimage", 2, 1, 1, None), ("update_postimage", 2, 1, 1, "n"), ("insert", 2, 4, 4, None), ("update_preimage", 2, None, 0, None), ("update_postimage", 2, None, 9, None)],
        key=repr,
    )
    assert rows(t.changes_since(at[2])) == rows(t.changes_between(3))
    assert t.changes_since(at[4]).count() == 0
    stamps = {r._commit_timestamp for r in t.changes_between(2, 3).collect()}
    assert stamps == {at[2], at[3]}
    for first, last in ((-1, 1), (2, 1), (0, 9)):
        with pytest.raises(ValueError):
            t.changes_between(first, last)


def test_net_changes_lead_from_the_first_to_the_last_version(spark, rows):
    """Applied to the first version, the net feed of any range gives the last one."""
    t = SnapshotTable(spark, fresh_dir(spark, "versions"), keys=["id"])
    for v in range(5):
        kept = spark.range(60).where((F.col("id") * 7 + v) % 5 > 0).select("id", (F.col("id") % (v + 2)).alias("v"))
        t.commit(kept, "WRITE", datetime(2024, 1, v + 1))
    for first, last in ((1, 4), (2, 3), (3, 3)):
        net = t.changes_between(first, last, net=True)
        went = net.where("_change_type IN ('delete', 'update_preimage')").select("id", "v")
        came = net.where("_change_type IN ('insert', 'update_postimage')").select("id", "v")
        assert rows(t.read(first - 1).exceptAll(went).unionAll(came)) == rows(t.read(last))
        assert went.exceptAll(t.read(first - 1)).isEmpty()
