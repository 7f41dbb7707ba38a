"""Data that does not keep to its schema: rescue, growing merges, feeds over versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from laketide.operators import changes
from laketide.plans.registry import query, table
from laketide.session import fresh_dir
from laketide.sources import rescue
from laketide.sources.evolution import GrowingTable
from laketide.sources.snapshots import SnapshotTable
from laketide.streaming import runners

# ---- rescue -----------------------------------------------------------------------------------

DECLARED = "event_id bigint, user_id bigint, event_type string, value double"
RESCUE_SQL = """SELECT f.format, event_id, user_id, event_type, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 2 = 1 AND event_type = 'click' AND event_id % 10 = 3 THEN '{"note":"n' || event_id || '","value":"n/a"}'
         WHEN event_id % 2 = 1 AND event_type = 'click' THEN '{"note":"n' || event_id || '"}'
         WHEN event_id % 10 = 3 THEN '{"value":"n/a"}' END AS _rescued_data
    FROM events, (VALUES ('csv'), ('json')) f(format)"""


def land_drifted(df, root: str) -> None:
    """Events as JSON and CSV whose values and columns drift: every tenth value is a text, clicks of
    odd ids carry a column nobody declared, and odd ids come in files with another column order."""
    odd = F.col("event_id") % 2 == 1
    note = F.when(odd & (F.col("event_type") == "click"), F.concat(F.lit("n"), F.col("event_id").cast("string")))
    spoiled = F.col("event_id") % 10 == 3
    columns = ["event_id", "user_id", "event_type"]
    rows = df.select(*columns, "value", note.alias("note"), spoiled.alias("spoiled"))
    fit, misfit = F.to_json(F.struct(*columns, "value", "note")), F.to_json(F.struct(*columns, F.lit("n/a").alias("value"), "note"))
    rows.select(F.when(F.col("spoiled"), misfit).otherwise(fit).alias("value")).write.mode("append").text(f"{root}/json")
    text = F.when(F.col("spoiled"), F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value")
    rows.where(~odd).select(*columns, text).write.mode("append").option("header", True).csv(f"{root}/csv")
    rows.where(odd).select("event_type", "note", "event_id", text, "user_id").write.mode("append").option("header", True).csv(f"{root}/csv")


@query("scan_rescue", RESCUE_SQL)
def scan_rescue(spark, sf):
    root = fresh_dir(spark, "rescue")
    land_drifted(table(spark, sf, "events"), root)
    csv = rescue.read_csv_rescued(spark, f"{root}/csv", DECLARED).withColumn("format", F.lit("csv"))
    json = rescue.read_json_rescued(spark, f"{root}/json", DECLARED).withColumn("format", F.lit("json"))
    return csv.unionByName(json).drop("_source_file")


@query("stream_rescue", RESCUE_SQL)
def stream_rescue(spark, sf):
    """The same files, arriving in two lots, as streams that continue where they stopped."""
    root = fresh_dir(spark, "rescue_stream")
    events = table(spark, sf, "events")
    middle = events.agg(F.avg("event_id")).first()[0] or 0

    def store(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{root}/csv_out/batch={batch_id}")

    for lot in (F.col("event_id") <= middle, F.col("event_id") > middle):
        land_drifted(events.where(lot), root)
        json = rescue.stream_json_rescued(spark, f"{root}/json", DECLARED)
        csv = rescue.stream_csv_lines(spark, f"{root}/csv")
        runners.await_all(
            [
                runners.append_to(json, f"{root}/json_out", f"{root}/json_checkpoint"),
                runners.run_batches(csv, rescue.rescued_batches(store, DECLARED), f"{root}/csv_checkpoint"),
            ]
        )
    csv = spark.read.parquet(f"{root}/csv_out").drop("batch").withColumn("format", F.lit("csv"))
    json = spark.read.parquet(f"{root}/json_out").withColumn("format", F.lit("json"))
    return csv.unionByName(json).drop("_source_file")


@query(
    "rescue_report",
    """SELECT COUNT(*) AS rows, COUNT(CASE WHEN event_id % 10 = 3 OR (event_id % 2 = 1 AND event_type = 'click') THEN 1 END) AS rescued_rows, CAST(4 AS BIGINT) AS files FROM events""",
)
def rescue_report(spark, sf):
    """Rows, rescued rows and files of an ingest under a declared schema."""
    root = fresh_dir(spark, "rescue_report")
    land_drifted(table(spark, sf, "events").repartition(4), root)
    return rescue.ingest_report(rescue.read_json_rescued(spark, f"{root}/json", DECLARED))


# ---- a merge that grows ---------------------------------------------------------------------------

GROWN_SQL = """s AS (SELECT CASE WHEN o_orderkey % 21 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k, o_totalprice, o_orderkey AS old, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0),
    ok AS (SELECT * FROM s WHERE old % 5 <> 0), bad AS (SELECT * FROM s WHERE old % 5 = 0),
    t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderkey % 100 AS units, o_orderstatus AS status FROM orders)"""


@query(
    "merge_evolve",
    f"""WITH {GROWN_SQL} SELECT coalesce(t.o_orderkey, k) AS o_orderkey, CAST(CASE WHEN k IS NULL THEN amount ELSE CAST(ok.o_totalprice + 1 AS DECIMAL(14,4)) END AS DOUBLE) AS amount,
    CASE WHEN k IS NULL THEN units ELSE 3000000000 + old END AS units, CASE WHEN k IS NULL THEN status ELSE 'M' END AS status,
    CASE WHEN k IS NULL THEN NULL ELSE 'seen' END AS note, CASE WHEN k IS NULL THEN NULL ELSE o_orderpriority END AS reviewed_by
    FROM t FULL OUTER JOIN ok ON t.o_orderkey = k""",
)
def merge_evolve(spark, sf):
    """The source brings a new column, a new field of a struct and two wider types."""
    state, _, _ = grown_orders(spark, sf)
    return state.select("o_orderkey", F.col("amount").cast("double").alias("amount"), "units", "info.status", "info.note", "reviewed_by")


@query(
    "merge_evolve_quarantine",
    f"""WITH {GROWN_SQL} SELECT k AS o_orderkey, CAST(CAST(o_totalprice + 1 AS DECIMAL(14,4)) AS DOUBLE) AS amount, 3000000000 + old AS units, o_orderpriority AS reviewed_by FROM bad
    UNION ALL SELECT o_orderkey, CAST(amount AS DOUBLE), units, NULL FROM t WHERE o_orderkey % 11 = 0""",
)
def merge_evolve_quarantine(spark, sf):
    """Rejected rows of two loads with different columns in one table that grows."""
    _, quarantine, _ = grown_orders(spark, sf)
    return quarantine.read().select("o_orderkey", F.col("amount").cast("double").alias("amount"), "units", "reviewed_by")


def grown_orders(spark, sf):
    """The merged state, the quarantine of both loads, and the target before."""
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    target = orders.select(k, F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), (k % 100).cast("int").alias("units"), F.struct(F.col("o_orderstatus").alias("status")).alias("info"))
    source = orders.where(k % 7 == 0).select(
        F.when(k % 21 == 0, k + 100000000).otherwise(k).alias("o_orderkey"),
        (F.col("o_totalprice") + 1).cast("decimal(14,4)").alias("amount"),
        (k + F.lit(3000000000)).alias("units"),
        F.struct(F.lit("M").alias("status"), F.lit("seen").alias("note")).alias("info"),
        F.col("o_orderpriority").alias("reviewed_by"),
        (k % 5 == 0).alias("bad"),
    )
    quarantine = GrowingTable(spark, fresh_dir(spark, "quarantine"))
    quarantine.append(target.where(k % 11 == 0))
    quarantine.append(source.where("bad").drop("bad"))
    good = source.where("NOT bad")
    return changes.merge(target, good, ["o_orderkey"], evolve=True, ignore=["bad"]), quarantine, target


# ---- feeds over several versions ------------------------------------------------------------------

DAYS = [datetime(2024, 2, d) for d in (1, 2, 3, 4)]
VERSIONS_SQL = """v0 AS (SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS reviewed_by FROM orders),
    v1 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, NULL AS reviewed_by FROM orders WHERE o_orderkey % 14 <> 3
           UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, NULL FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT NULL, 'N', NULL),
    v2 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 1 AND o_orderkey % 24 <> 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 'rev' END AS reviewed_by
           FROM orders WHERE o_orderkey % 28 <> 3
           UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, NULL FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT NULL, 'M', 'rev')"""


def feed_sql(before: str, after: str, version: int) -> str:
    pairs = f"{before} b FULL OUTER JOIN {after} a ON a.here IS NOT DISTINCT FROM b.here AND a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey"
    pairs = pairs.replace(f"{before} b", f"(SELECT *, 1 AS here FROM {before}) b").replace(f"{after} a", f"(SELECT *, 1 AS here FROM {after}) a")
    changed = "(a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.reviewed_by IS DISTINCT FROM b.reviewed_by)"
    old, new = "b.o_orderkey, b.o_orderstatus, b.reviewed_by", "a.o_orderkey, a.o_orderstatus, a.reviewed_by"
    return f"""SELECT {version} AS v, CASE WHEN a.here IS NULL THEN 'delete' ELSE 'update_preimage' END AS _change_type, {old} FROM {pairs} WHERE b.here = 1 AND (a.here IS NULL OR {changed})
    UNION ALL SELECT {version}, CASE WHEN b.here IS NULL THEN 'insert' ELSE 'update_postimage' END, {new} FROM {pairs} WHERE a.here = 1 AND (b.here IS NULL OR {changed})"""


def versioned(spark, sf) -> SnapshotTable:
    """Three versions of all orders: updates, deletes, inserts and a NULL key; then some of it is
    undone and a column is added."""
    t = SnapshotTable(spark, fresh_dir(spark, "feed"), keys=["o_orderkey"])
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    one = lambda s: spark.createDataFrame([(None, s)], "o_orderkey bigint, o_orderstatus string")
    v0 = orders.drop("o_orderpriority")
    t.commit(v0, "WRITE", DAYS[0])
    new = v0.withColumn("o_orderkey", k + 100000000)
    v1 = v0.where(k % 14 != 3).withColumn("o_orderstatus", F.when(k % 12 == 1, "X").otherwise(status))
    t.commit(v1.unionByName(new.where(k % 50 == 0)).unionByName(one("N")), "MERGE", DAYS[1])
    v2 = v0.where(k % 28 != 3).select(k, F.when((k % 12 == 1) & (k % 24 != 1), "X").otherwise(status).alias("o_orderstatus"), F.when(k % 9 == 0, "rev").alias("reviewed_by"))
    late = new.where(k % 100 == 0).withColumn("reviewed_by", F.lit(None).cast("string"))
    t.commit(v2.unionByName(late).unionByName(one("M").withColumn("reviewed_by", F.lit("rev"))), "MERGE", DAYS[2])
    return t


@query(
    "change_feed_range",
    f"""WITH {VERSIONS_SQL}, c1 AS ({feed_sql('v0', 'v1', 1)}), c2 AS ({feed_sql('v1', 'v2', 2)}), net AS ({feed_sql('v0', 'v2', 2)}),
    commits AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)
    SELECT 'gross' AS kind, _change_type, o_orderkey, o_orderstatus, reviewed_by, v AS _commit_version, TIMESTAMP '2024-02-01 00:00:00' + v * INTERVAL 1 DAY AS _commit_timestamp FROM commits
    UNION ALL SELECT 'net', net._change_type, net.o_orderkey, net.o_orderstatus, net.reviewed_by, m.v, TIMESTAMP '2024-02-01 00:00:00' + m.v * INTERVAL 1 DAY
    FROM net JOIN (SELECT o_orderkey, max(v) AS v FROM commits GROUP BY 1) m ON m.o_orderkey IS NOT DISTINCT FROM net.o_orderkey""",
)
def change_feed_range(spark, sf):
    """All changes of two commits, and what they come to."""
    t = versioned(spark, sf)
    gross, net = t.changes_between(1, 2), t.changes_between(1, 2, net=True)
    return gross.withColumn("kind", F.lit("gross")).unionByName(net.withColumn("kind", F.lit("net")))


@query(
    "change_feed_since",
    f"""WITH {VERSIONS_SQL}, c2 AS ({feed_sql('v1', 'v2', 2)}) SELECT o_orderstatus, COUNT(CASE WHEN _change_type IN ('insert', 'update_postimage') THEN 1 END) AS came,
    COUNT(CASE WHEN _change_type IN ('delete', 'update_preimage') THEN 1 END) AS went FROM c2 GROUP BY 1""",
)
def change_feed_since(spark, sf):
    """Changes after a time, counted by status."""
    new = F.col("_change_type").isin("insert", "update_postimage")
    return versioned(spark, sf).changes_since(DAYS[1]).groupBy("o_orderstatus").agg(F.count_if(new).alias("came"), F.count_if(~new).alias("went"))
