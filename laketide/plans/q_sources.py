"""Sources, sinks, table layout and execution shape. Files are written from the given tables
into the shared folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions.scalars import mean, money, total
from laketide.operators.aggregates import exact_quantiles
from laketide.operators.joins import broadcast_if_small
from laketide.plans.fixtures import as_of
from laketide.plans.q_relational import GOLD_SQL, gold
from laketide.plans.registry import query, sql_mean, sql_total, table
from laketide.session import fresh_dir
from laketide.sources import layout, writers
from laketide.sources.evolution import add_columns, append_evolving, read_merged, rescue_columns
from laketide.sources.readers import load_if_missing, load_sources, read_csv, read_json_lines, with_audit

# ---- scans ----------------------------------------------------------------------------------


@query("parquet_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' AND l_quantity > 40")
def parquet_scan(spark, sf):
    recent = F.col("l_shipdate") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "lineitem").where(recent & (F.col("l_quantity") > 40)).select("l_orderkey", "l_extendedprice")


@query(
    "csv_scan_inferred",
    "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_scan_inferred(spark, sf):
    path = fresh_dir(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query(
    "csv_scan_typed",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS tax_id, c_name AS full_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer""",
)
def csv_scan_typed(spark, sf):
    path = fresh_dir(spark, "csv")
    c = table(spark, sf, "customer")
    rows = c.select(F.lpad(c.c_custkey.cast("string"), 9, "0").alias("tax_id"), c.c_name.alias("full_name"), money("c_acctbal").alias("balance"))
    rows.write.option("header", True).csv(path)
    typed = read_csv(spark, path, "tax_id string, full_name string, balance decimal(18,2)", mode="FAILFAST")
    return typed.withColumn("balance", F.col("balance").cast("double"))


@query("csv_scan_glob", f"SELECT o_orderpriority, COUNT(*) AS n, {sql_total('o_totalprice')} AS amount FROM orders GROUP BY 1")
def csv_scan_glob(spark, sf):
    path = fresh_dir(spark, "csv")
    table(spark, sf, "orders").select("o_orderpriority", "o_totalprice").repartition(6).write.option("header", True).csv(path)
    many = read_csv(spark, f"{path}/*.csv", "o_orderpriority string, o_totalprice double")
    return many.groupBy("o_orderpriority").agg(F.count("*").alias("n"), total("o_totalprice").alias("amount"))


@query("json_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def json_scan(spark, sf):
    path = fresh_dir(spark, "json")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    table(spark, sf, "events").drop("props").write.option("timestampNTZFormat", micros).json(path)
    return read_json_lines(spark, path, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


@query(
    "literal_relation",
    """SELECT status_name, COUNT(*) AS n FROM orders JOIN (VALUES ('F', 'approved'), ('O', 'pending'), ('P', 'rejected')) v(code, status_name)
    ON o_orderstatus = code GROUP BY status_name""",
)
def literal_relation(spark, sf):
    names = spark.createDataFrame([("F", "approved"), ("O", "pending"), ("P", "rejected")], "o_orderstatus string, status_name string")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.join(names, "o_orderstatus").select("status_name", "n")


@query(
    "range_fact",
    f"""WITH k AS (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS id)
    SELECT id % 8 AS slot, COUNT(*) AS keys, COUNT(o_orderkey) AS used, {sql_total('o_totalprice')} AS amount
    FROM k LEFT JOIN orders ON id = o_orderkey GROUP BY 1""",
)
def range_fact(spark, sf):
    """A generated key range, as long as the table's key space, with the table joined to it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    keys = spark.range(o.agg(F.max("o_orderkey")).first()[0] + 1)
    both = keys.join(o, F.col("id") == F.col("o_orderkey"), "left")
    return both.groupBy((F.col("id") % 8).alias("slot")).agg(
        F.count("*").alias("keys"), F.count("o_orderkey").alias("used"), total("o_totalprice").alias("amount")
    )


@query(
    "audit_columns",
    """SELECT o_orderkey, 'orders.parquet' AS _source_file, 'run-1' AS _run_id, 'full' AS _load_type, DATE '2024-01-31' AS _ingest_date,
    TIMESTAMP '2024-01-31 00:00:00' AS _ingested_at FROM orders""",
)
def audit_columns(spark, sf):
    file_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = table(spark, sf, "orders").select("o_orderkey", file_name.alias("file"))
    return with_audit(rows, "run-1", "full", as_of(), F.col("file")).drop("file")


@query("load_if_missing", "SELECT o_orderkey, o_totalprice FROM orders")
def load_if_missing_query(spark, sf):
    """The second call finds the table and never builds it again."""
    path, o = fresh_dir(spark, "orders"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    load_if_missing(spark, path, lambda: o)
    return load_if_missing(spark, path, lambda: o.where("false"))


@query(
    "config_loader",
    """SELECT 'customers' AS source, COUNT(*) AS rows, 'full' AS load_type FROM customer UNION ALL SELECT 'declarations', COUNT(*), 'full' FROM orders
    UNION ALL SELECT 'suppliers', COUNT(*), 'full' FROM supplier""",
)
def config_loader(spark, sf):
    root = fresh_dir(spark, "landing")
    table(spark, sf, "customer").select("c_custkey", "c_name").write.option("header", True).csv(f"{root}/customer")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.json(f"{root}/orders")
    config = [
        {"name": "customers", "path": f"{root}/customer", "format": "csv", "schema": "c_custkey bigint, c_name string", "options": {"header": True}},
        {"name": "declarations", "path": f"{root}/orders", "format": "json", "schema": "o_orderkey bigint, o_totalprice double"},
        {"name": "suppliers", "path": f"{sf}/supplier.parquet", "format": "parquet"},
    ]
    out = None
    for frame in load_sources(spark, config, "run-1", as_of()).values():
        rows = frame.groupBy(F.col("_source").alias("source"), F.col("_load_type").alias("load_type")).agg(F.count("*").alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"


@query(
    "rescue_columns",
    """SELECT event_id, user_id, event_type, value, '{"props":' || CAST(to_json(props) AS VARCHAR) || '}' AS _rescued_data FROM events""",
)
def rescue_columns_query(spark, sf):
    expected = spark.createDataFrame([], EVENT_SCHEMA).schema
    return rescue_columns(table(spark, sf, "events").drop("ts"), expected)


@query(
    "ingest_summary",
    "SELECT COUNT(*) AS rows, COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS rescued_rows, CAST(4 AS BIGINT) AS files FROM events",
)
def ingest_summary(spark, sf):
    """Rows, rows with rescued data and source files of an ingest where only click events
    carry the unexpected column."""
    path = fresh_dir(spark, "json")
    extra = F.when(F.col("event_type") == "click", F.col("props"))
    table(spark, sf, "events").withColumn("props", extra).drop("ts").repartition(4).write.json(path)
    raw = read_json_lines(spark, path, EVENT_SCHEMA + ", props string").select("*", F.col("_metadata.file_path").alias("file"))
    expected = spark.createDataFrame([], EVENT_SCHEMA + ", file string").schema
    return rescue_columns(raw, expected).agg(
        F.count("*").alias("rows"), F.count("_rescued_data").alias("rescued_rows"), F.countDistinct("file").alias("files")
    )


@query(
    "evolve_add_columns",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN o_orderpriority END AS o_orderpriority,
    CAST(NULL AS VARCHAR) AS reviewed_by FROM orders""",
)
def evolve_add_columns(spark, sf):
    """The second batch brings a column the first one lacks; a third column is added empty."""
    path, o = fresh_dir(spark, "evolve"), table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    append_evolving(o.where(~late).select("o_orderkey", "o_totalprice"), path)
    append_evolving(o.where(late).select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return add_columns(read_merged(spark, path), {"reviewed_by": "string"})


# ---- sinks ------------------------------------------------------------------------------------


@query("write_overwrite", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def write_overwrite(spark, sf):
    """Empty clone, first load, then a replacement with another schema."""
    path, o = fresh_dir(spark, "overwrite"), table(spark, sf, "orders")
    writers.create_empty_like(o, path)
    writers.overwrite(o, path)
    writers.overwrite(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.parquet(path)


@query("write_append", "SELECT o_orderkey, o_totalprice FROM orders")
def write_append(spark, sf):
    path, o = fresh_dir(spark, "append"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for condition in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        writers.append(o.where(condition).drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query("partitioned_write_prune", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def partitioned_write_prune(spark, sf):
    path = fresh_dir(spark, "partitioned")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    writers.overwrite(writers.clustered(rows, ["o_orderstatus"]), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'P' AND o_totalprice > 1000")


@query(
    "replace_partition",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS fy FROM orders""",
)
def replace_partition(spark, sf):
    """One year is loaded again, twice, with corrected rows; the other years stay."""
    path = fresh_dir(spark, "by_year")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("fy"))
    writers.replace_partitions(rows, path, ["fy"])
    corrected = rows.where("fy = 1997").withColumn("o_orderstatus", F.lit("R"))
    for _ in range(2):
        writers.replace_partitions(corrected, path, ["fy"])
    return spark.read.parquet(path)


@query(
    "ctas_daily_summary",
    f"""SELECT CAST(o_orderdate AS DATE) AS run_date, o_orderpriority AS category, COUNT(*) AS n, {sql_total('o_totalprice')} AS amount FROM orders GROUP BY 1, 2""",
)
def ctas_daily_summary(spark, sf):
    path = fresh_dir(spark, "daily_summary")
    name = "lt_" + path.rsplit("-", 1)[-1]
    table(spark, sf, "orders").createOrReplaceTempView(f"{name}_orders")
    spark.sql(
        f"""CREATE TABLE {name} USING parquet LOCATION '{path}' AS
        SELECT CAST(o_orderdate AS DATE) AS run_date, o_orderpriority AS category, COUNT(*) AS n,
          CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM {name}_orders GROUP BY 1, 2"""
    )
    return spark.table(name)


@query(
    "view_regional_summary",
    f"""WITH {GOLD_SQL} SELECT region, CAST(SUM(declarations) AS BIGINT) AS declarations, {sql_total('total_amount')} AS total_amount,
    {sql_total('total_amount')} / CAST(SUM(declarations) AS BIGINT) AS avg_amount, CAST(SUM(approved) AS BIGINT) AS approved FROM g GROUP BY region""",
)
def view_regional_summary(spark, sf):
    gold(spark, sf).createOrReplaceTempView("lt_gold")
    return spark.sql(
        """SELECT region, SUM(declarations) AS declarations, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
        CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / SUM(declarations) AS avg_amount, SUM(approved) AS approved
        FROM lt_gold GROUP BY region"""
    )


# ---- layout and execution shape ----------------------------------------------------------------


@query("compact_files", "SELECT COUNT(*) AS rows, true AS fewer_files FROM orders")
def compact_files(spark, sf):
    small, large = fresh_dir(spark, "small_files"), fresh_dir(spark, "compacted")
    table(spark, sf, "orders").repartition(24).write.parquet(small)
    writers.compact(spark, small, large)
    before, after = (writers.file_counts(spark, p) for p in (small, large))
    both = before.select(F.col("files").alias("files_before"), F.col("rows").alias("r0")).join(
        after.select("files", "rows"), F.col("r0") == F.col("rows")
    )
    return both.select("rows", (F.col("files") < F.col("files_before")).alias("fewer_files"))


@query("cluster_layout", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 100 AND 300 AND o_totalprice > 100000")
def cluster_layout(spark, sf):
    """Clustered by date first, then clustered again by customer for another access path."""
    by_date, by_customer = fresh_dir(spark, "by_date"), fresh_dir(spark, "by_customer")
    writers.cluster(table(spark, sf, "orders"), by_date, ["o_orderdate", "o_custkey"], files=8)
    writers.cluster(spark.read.parquet(by_date), by_customer, ["o_custkey"], files=8)
    wanted = spark.read.parquet(by_customer).where("o_custkey BETWEEN 100 AND 300 AND o_totalprice > 100000")
    return wanted.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "zorder_layout",
    """SELECT c.column_name AS column_name, CASE c.column_name WHEN 'l_partkey' THEN (SELECT COUNT(*) FROM lineitem WHERE l_partkey BETWEEN (SELECT quantile_disc(l_partkey, 0.5) FROM lineitem) AND (SELECT quantile_disc(l_partkey, 0.51) FROM lineitem))
      ELSE (SELECT COUNT(*) FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-01-20 00:00:00') END AS rows,
    true AS skips_most, CASE c.column_name WHEN 'l_partkey' THEN false ELSE true END AS fewer_than_sorted FROM (VALUES ('l_partkey'), ('l_shipdate')) c(column_name)""",
)
def zorder_layout(spark, sf):
    """Line items by part and date at once, beside the same files sorted by part, then date: what a
    narrow filter on either column returns, and how many files it cannot skip."""
    flat, woven = fresh_dir(spark, "sorted"), fresh_dir(spark, "zorder")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    keys, files = ["l_partkey", "l_shipdate"], 36
    writers.cluster(lines, flat, keys, files=files)
    layout.zorder(lines, woven, keys, files=files)
    low, high = exact_quantiles(lines, "l_partkey", (0.5, 0.51)).first()
    days = [F.lit(f"1997-01-{d} 00:00:00").cast("timestamp_ntz") for d in ("01", "20")]
    out = None
    for column, ends in (("l_partkey", (F.ceil(F.lit(low)), F.floor(F.lit(high)))), ("l_shipdate", days)):
        rows = spark.read.parquet(woven).where(F.col(column).between(*ends)).agg(F.count("*").alias("rows"))
        z, s = (layout.files_touched(layout.file_ranges(spark, p, keys), column, *ends).first() for p in (woven, flat))
        part = rows.select(
            F.lit(column).alias("column_name"),
            "rows",
            F.lit(2 * z["touched"] < z["files"]).alias("skips_most"),
            F.lit(z["touched"] < s["touched"]).alias("fewer_than_sorted"),
        )
        out = part if out is None else out.union(part)
    return out


@query(
    "materialize_agg",
    f"""WITH a AS (SELECT o_custkey, {sql_total('o_totalprice')} AS amount FROM orders GROUP BY 1)
    SELECT 'above' AS side, COUNT(*) AS customers FROM a WHERE amount >= 2500000 UNION ALL SELECT 'below', COUNT(*) FROM a WHERE amount < 2500000""",
)
def materialize_agg(spark, sf):
    """An aggregate read twice is stored once."""
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(total("o_totalprice").alias("amount"))
    stored = writers.materialize(per_customer, fresh_dir(spark, "per_customer"))
    above, below = stored.where("amount >= 2500000"), stored.where("amount < 2500000")
    return above.agg(F.count("*").alias("customers")).select(F.lit("above").alias("side"), "customers").union(
        below.agg(F.count("*").alias("customers")).select(F.lit("below"), "customers")
    )


@query(
    "perf_recipe",
    f"""SELECT n_name, COUNT(*) AS lines, {sql_total('l_extendedprice')} AS revenue, {sql_mean('l_quantity')} AS avg_quantity
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""",
)
def perf_recipe(spark, sf):
    """Filter and prune at the scan, meet the measured small dimension, aggregate."""
    recent = F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS n_nationkey")
    places = suppliers.join(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").drop("n_nationkey")
    lines = table(spark, sf, "lineitem").where(recent).select("l_suppkey", "l_extendedprice", "l_quantity")
    return lines.join(broadcast_if_small(places), "l_suppkey").groupBy("n_name").agg(
        F.count("*").alias("lines"), total("l_extendedprice").alias("revenue"), mean("l_quantity").alias("avg_quantity")
    )
