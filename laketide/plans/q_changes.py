"""Table changes: merge family, snapshots, change feed, SCD2, incremental loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from laketide.functions.scalars import money, total
from laketide.operators import changes, scd
from laketide.operators.aggregates import reconcile
from laketide.operators.incremental import IncrementalTable, cost_report, same_state
from laketide.plans.q_basics import VERSION_SQL, order_versions
from laketide.plans.registry import query, sql_total, table
from laketide.session import fresh_dir
from laketide.sources.snapshots import SnapshotTable

T0, T1, T2, T3 = (datetime(2024, 1, d) for d in (1, 2, 3, 4))

TARGET_SQL = "t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders)"
SOURCE_SQL = """s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, 'X' AS o_orderstatus,
    o_totalprice + 1000 AS o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 5 DAY ELSE o_orderdate - INTERVAL 5 DAY END AS o_orderdate,
    CASE WHEN o_orderkey % 3 = 0 THEN 'DELETE' WHEN o_orderkey % 3 = 1 THEN 'UPDATE' ELSE 'INSERT' END AS op
  FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 50 = 0)"""
COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def target_rows(spark, sf):
    return table(spark, sf, "orders").select(*COLUMNS)


def source_rows(spark, sf):
    k = F.col("o_orderkey")
    moved = F.when(k % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).otherwise(F.col("o_orderdate") - F.expr("INTERVAL 5 DAYS"))
    return table(spark, sf, "orders").where((k % 7 == 0) | (k % 50 == 0)).select(
        F.when(k % 50 == 0, k + 100000000).otherwise(k).alias("o_orderkey"),
        F.lit("X").alias("o_orderstatus"),
        (F.col("o_totalprice") + 1000).alias("o_totalprice"),
        moved.alias("o_orderdate"),
        F.when(k % 3 == 0, "DELETE").when(k % 3 == 1, "UPDATE").otherwise("INSERT").alias("op"),
    )


def merge_sql(take: str, insert: dict[str, str] | None = None, where: str = "true") -> str:
    """Full-join form of a merge: ``take`` decides between the two sides of a matched row."""
    columns = []
    for c in COLUMNS[1:]:
        new = (insert or {}).get(c, f"s.{c}")
        old = f"t.{c}" if new == "NULL" else f"CASE WHEN {take} THEN {new} ELSE t.{c} END"
        columns.append(f"CASE WHEN t.o_orderkey IS NULL THEN {new} ELSE {old} END AS {c}")
    return f"""WITH {TARGET_SQL}, {SOURCE_SQL} SELECT COALESCE(t.o_orderkey, s.o_orderkey) AS o_orderkey, {', '.join(columns)}
    FROM t FULL OUTER JOIN s ON t.o_orderkey = s.o_orderkey WHERE {where}"""


HIT = "s.o_orderkey IS NOT NULL"


@query("merge_upsert_all", merge_sql(HIT))
def merge_upsert_all(spark, sf):
    return changes.merge(target_rows(spark, sf), source_rows(spark, sf), ["o_orderkey"], ignore=["op"])


@query("merge_partial", merge_sql(HIT, {"o_totalprice": "NULL", "o_orderdate": "NULL"}))
def merge_partial(spark, sf):
    source = source_rows(spark, sf).select("o_orderkey", "o_orderstatus")
    return changes.merge(
        target_rows(spark, sf), source, ["o_orderkey"], update=["o_orderstatus"], insert=["o_orderkey", "o_orderstatus"]
    )


@query("merge_if_newer", merge_sql(f"({HIT} AND s.o_orderdate > t.o_orderdate)"))
def merge_if_newer(spark, sf):
    newer = "s.o_orderdate > t.o_orderdate"
    return changes.merge(target_rows(spark, sf), source_rows(spark, sf), ["o_orderkey"], when_matched=newer, ignore=["op"])


@query("merge_cdc_ops", merge_sql(HIT, where="s.op IS NULL OR s.op <> 'DELETE'"))
def merge_cdc_ops(spark, sf):
    return changes.merge(target_rows(spark, sf), source_rows(spark, sf), ["o_orderkey"], delete_when="s.op = 'DELETE'", ignore=["op"])


@query(
    "update_where",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def update_where(spark, sf):
    large = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000)
    return changes.update_where(table(spark, sf, "orders"), large, {"o_orderstatus": F.lit("H")}).select("o_orderkey", "o_orderstatus")


@query("delete_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)")
def delete_where(spark, sf):
    small = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000)
    return changes.delete_where(table(spark, sf, "orders"), small).select("o_orderkey", "o_orderstatus")


@query("insert_rows", f"WITH {TARGET_SQL}, {SOURCE_SQL} SELECT * FROM t UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM s WHERE o_orderkey >= 100000000")
def insert_rows(spark, sf):
    return target_rows(spark, sf).unionByName(source_rows(spark, sf).where("o_orderkey >= 100000000").drop("op"))


# ---- snapshots ---------------------------------------------------------------------------------


def versioned_orders(spark, sf) -> SnapshotTable:
    """Three commits: load, update, delete."""
    snapshots = SnapshotTable(spark, fresh_dir(spark, "orders_versions"))
    v0, v1 = order_versions(spark, sf)
    snapshots.commit(v0, "WRITE", T0)
    snapshots.commit(v1, "MERGE", T1)
    snapshots.commit(v1.where("o_orderstatus <> 'X'"), "DELETE", T2)
    return snapshots


def summarized(df, name):
    return df.agg(F.count("*").alias("rows"), total("o_totalprice").alias("amount")).select(F.lit(name).alias("version"), "rows", "amount")


@query(
    "time_travel",
    f"""WITH {VERSION_SQL} SELECT 'v0' AS version, COUNT(*) AS rows, {sql_total('o_totalprice')} AS amount FROM v0
    UNION ALL SELECT 'as of day 2', COUNT(*), {sql_total('o_totalprice')} FROM v1
    UNION ALL SELECT 'latest', COUNT(*), {sql_total('o_totalprice')} FROM v1 WHERE o_orderstatus <> 'X'""",
)
def time_travel(spark, sf):
    t = versioned_orders(spark, sf)
    reads = [("v0", t.read(0)), ("as of day 2", t.read_as_of(datetime(2024, 1, 2, 12))), ("latest", t.read())]
    out = None
    for name, df in reads:
        out = summarized(df, name) if out is None else out.union(summarized(df, name))
    return out


@query("restore_version", f"WITH {VERSION_SQL} SELECT * FROM v0")
def restore_version(spark, sf):
    t = versioned_orders(spark, sf)
    t.restore(0, T3)
    return t.read()


@query(
    "version_history",
    f"""WITH {VERSION_SQL} SELECT CAST(0 AS INTEGER) AS version, TIMESTAMP '2024-01-01 00:00:00' AS committed_at, 'WRITE' AS operation, COUNT(*) AS rows_written FROM v0
    UNION ALL SELECT 1, TIMESTAMP '2024-01-02 00:00:00', 'MERGE', COUNT(*) FROM v1
    UNION ALL SELECT 2, TIMESTAMP '2024-01-03 00:00:00', 'DELETE', COUNT(*) FROM v1 WHERE o_orderstatus <> 'X'""",
)
def version_history(spark, sf):
    return versioned_orders(spark, sf).history()


# ---- change feed ---------------------------------------------------------------------------------

FEED_SQL = f"""{VERSION_SQL}, feed AS (
  SELECT 'insert' AS _change_type, v1.* FROM v1 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v0)
  UNION ALL SELECT 'delete', v0.* FROM v0 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v1)
  UNION ALL SELECT 'update_preimage', v0.* FROM v0 JOIN v1 USING (o_orderkey) WHERE v0.o_orderstatus <> v1.o_orderstatus OR v0.o_totalprice <> v1.o_totalprice
  UNION ALL SELECT 'update_postimage', v1.* FROM v0 JOIN v1 USING (o_orderkey) WHERE v0.o_orderstatus <> v1.o_orderstatus OR v0.o_totalprice <> v1.o_totalprice)"""


def order_feed(spark, sf):
    v0, v1 = order_versions(spark, sf)
    return changes.change_feed(v0, v1, ["o_orderkey"])


def by_status(df):
    return df.groupBy("o_orderstatus").agg(F.sum(money("o_totalprice")).alias("amount"), F.count("*").alias("n"))


@query("change_feed", f"WITH {FEED_SQL} SELECT *, CAST(1 AS INTEGER) AS _commit_version FROM feed")
def change_feed(spark, sf):
    v0, v1 = order_versions(spark, sf)
    return changes.change_feed(v0, v1, ["o_orderkey"], version=1)


SIGN_SQL = "CASE WHEN _change_type IN ('insert', 'update_postimage') THEN 1 ELSE -1 END"


@query(
    "net_delta",
    f"""WITH {FEED_SQL} SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * {SIGN_SQL}) AS DOUBLE) AS delta,
    CAST(SUM({SIGN_SQL}) AS BIGINT) AS row_delta FROM feed GROUP BY 1""",
)
def net_delta(spark, sf):
    net = changes.net_change(order_feed(spark, sf), ["o_orderstatus"], money("o_totalprice"))
    return net.withColumn("delta", F.col("delta").cast("double"))


@query("apply_delta", f"WITH {VERSION_SQL} SELECT o_orderstatus, {sql_total('o_totalprice')} AS amount, COUNT(*) AS n FROM v1 GROUP BY 1")
def apply_delta(spark, sf):
    """The old aggregate plus the net change is the new aggregate."""
    v0, _ = order_versions(spark, sf)
    net = changes.net_change(order_feed(spark, sf), ["o_orderstatus"], money("o_totalprice"))
    moved = changes.apply_delta(by_status(v0), net, ["o_orderstatus"], {"amount": "delta", "n": "row_delta"})
    return moved.withColumn("amount", F.col("amount").cast("double"))


@query(
    "affected_recompute",
    f"""WITH {VERSION_SQL} SELECT o_orderkey % 2000 AS slot, {sql_total('o_totalprice')} AS amount, COUNT(*) AS n FROM v1 GROUP BY 1""",
)
def affected_recompute(spark, sf):
    v0, v1 = (v.withColumn("slot", F.col("o_orderkey") % 2000) for v in order_versions(spark, sf))
    feed = changes.change_feed(v0, v1, ["o_orderkey"])
    aggs = [F.sum(money("o_totalprice")).alias("amount"), F.count("*").alias("n")]
    fresh = changes.recompute_affected(v0.groupBy("slot").agg(*aggs), feed, v1, ["slot"], aggs)
    return fresh.withColumn("amount", F.col("amount").cast("double"))


@query(
    "incremental_equals_full",
    f"""WITH {VERSION_SQL}, a AS (SELECT o_orderstatus, {sql_total('o_totalprice')} AS x FROM v1 GROUP BY 1)
    SELECT o_orderstatus, x AS left_value, x AS right_value, true AS matches FROM a""",
)
def incremental_equals_full(spark, sf):
    _, v1 = order_versions(spark, sf)
    full = v1.groupBy("o_orderstatus").agg(total("o_totalprice").alias("amount"))
    return reconcile(apply_delta(spark, sf).drop("n"), full, ["o_orderstatus"], "amount")


# ---- slowly changing dimension ---------------------------------------------------------------------

SCD_SQL = """day1 AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 5 <> 0),
  day2 AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 1 OR c_custkey % 7 = 2),
  day3 AS (SELECT c_custkey, 'LATE' AS c_mktsegment, c_nationkey + 1 AS c_nationkey FROM customer WHERE c_custkey % 11 = 2),
  obs AS (SELECT *, 1 AS d FROM day1 UNION ALL SELECT *, 2 FROM day2 UNION ALL SELECT *, 3 FROM day3),
  marked AS (SELECT *, lag(c_mktsegment) OVER w AS ps, lag(c_nationkey) OVER w AS pn, lag(d) OVER w AS pd FROM obs WINDOW w AS (PARTITION BY c_custkey ORDER BY d)),
  kept AS (SELECT * FROM marked WHERE pd IS NULL OR ps <> c_mktsegment OR pn <> c_nationkey),
  dim AS (SELECT c_custkey, c_mktsegment, c_nationkey, CAST(row_number() OVER w AS INTEGER) AS version,
    TIMESTAMP '2024-01-01 00:00:00' + (d - 1) * INTERVAL 1 DAY AS valid_from,
    TIMESTAMP '2024-01-01 00:00:00' + (lead(d) OVER w - 1) * INTERVAL 1 DAY AS valid_to, lead(d) OVER w IS NULL AS is_current
    FROM kept WINDOW w AS (PARTITION BY c_custkey ORDER BY d))"""
TRACKED = ["c_mktsegment", "c_nationkey"]


def at(day: int):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")


def scd_batches(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", *TRACKED)
    k = F.col("c_custkey")
    day2 = c.where((k % 5 == 0) | (k % 7).isin(1, 2)).withColumn("c_mktsegment", F.when(k % 7 == 1, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    day3 = c.where(k % 11 == 2).withColumn("c_mktsegment", F.lit("LATE")).withColumn("c_nationkey", F.col("c_nationkey") + 1)
    return c.where(k % 5 != 0), day2, day3


def scd_dimension(spark, sf):
    day1, day2, day3 = scd_batches(spark, sf)
    dim = scd.merge_by_values(scd.initial(day1, at(1)), day2, ["c_custkey"], TRACKED, at(2))
    return scd.merge_by_values(dim, day3, ["c_custkey"], TRACKED, at(3))


@query("scd2_merge", f"WITH {SCD_SQL} SELECT * FROM dim")
def scd2_merge(spark, sf):
    return scd_dimension(spark, sf)


@query("scd2_hash", f"WITH {SCD_SQL} SELECT * FROM dim")
def scd2_hash(spark, sf):
    """Decided by a fingerprint. The first merge is stored, so the second one reads a table
    instead of repeating the first."""
    day1, day2, day3 = scd_batches(spark, sf)
    dim = scd.initial(scd.with_hash(day1, TRACKED), at(1))
    merged = scd.merge_by_hash(dim, day2, ["c_custkey"], TRACKED, at(2))
    path = fresh_dir(spark, "scd2_hash")
    merged.write.parquet(path)
    stored = spark.read.parquet(path)
    return scd.merge_by_hash(stored, day3, ["c_custkey"], TRACKED, at(3)).drop("row_hash")


@query(
    "scd2_history",
    f"""WITH {SCD_SQL} SELECT 'current' AS view_name, c_mktsegment, COUNT(*) AS n FROM dim WHERE is_current GROUP BY 2
    UNION ALL SELECT 'as of day 2', c_mktsegment, COUNT(*) FROM dim WHERE valid_from <= TIMESTAMP '2024-01-02 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-02 12:00:00') GROUP BY 2
    UNION ALL SELECT 'history', c_mktsegment, COUNT(*) FROM dim WHERE NOT is_current GROUP BY 2""",
)
def scd2_history(spark, sf):
    path = fresh_dir(spark, "scd2")
    scd_dimension(spark, sf).write.parquet(path)
    dim = spark.read.parquet(path)
    noon = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    out = None
    for name, df in (("current", scd.current(dim)), ("as of day 2", scd.as_of(dim, noon)), ("history", dim.where("NOT is_current"))):
        counts = df.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.lit(name).alias("view_name"), "c_mktsegment", "n")
        out = counts if out is None else out.union(counts)
    return out


# ---- full and incremental loads ---------------------------------------------------------------------


def loaded_orders(spark, sf) -> IncrementalTable:
    """A full load of the first half of the key space, then two incremental loads."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    top = o.agg(F.max("o_orderkey")).first()[0]
    t = IncrementalTable(spark, fresh_dir(spark, "loads"))
    t.full_load(o.where(F.col("o_orderkey") <= top // 2), "r1", "o_orderkey", T0)
    t.incremental_load(o.where(F.col("o_orderkey") <= top * 3 // 4), "r2", "o_orderkey", T1)
    t.incremental_load(o, "r3", "o_orderkey", T2)
    return t


@query("full_load", "SELECT o_orderkey, o_totalprice FROM orders")
def full_load(spark, sf):
    t = IncrementalTable(spark, fresh_dir(spark, "loads"))
    t.full_load(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "r1", "o_orderkey", T0)
    return t.read()


@query("incremental_load", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def incremental_load(spark, sf):
    return loaded_orders(spark, sf).read()


@query(
    "load_cost_report",
    """SELECT 'full' AS load_type, CAST(1 AS BIGINT) AS runs, COUNT(*) AS rows_loaded FROM orders WHERE o_orderkey <= (SELECT MAX(o_orderkey) // 2 FROM orders)
    UNION ALL SELECT 'incremental', 2, COUNT(*) FROM orders WHERE o_orderkey > (SELECT MAX(o_orderkey) // 2 FROM orders)""",
)
def load_cost_report(spark, sf):
    return cost_report(loaded_orders(spark, sf).log())


@query("idempotent_rerun", "SELECT CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, true AS same FROM (SELECT COUNT(*) FROM orders)")
def idempotent_rerun(spark, sf):
    t = loaded_orders(spark, sf)
    before = t.read()
    t.incremental_load(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "r3", "o_orderkey", T2)
    t.incremental_load(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "r4", "o_orderkey", T3)
    return same_state(before, t.read())
