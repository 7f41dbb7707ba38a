"""Joins, aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from laketide.functions.scalars import mean, money, percent, total
from laketide.operators.aggregates import (
    duplicate_keys,
    exact_quantiles,
    group_skew,
    null_counts,
    profile,
    reconcile,
    rows_per_partition,
    salt_of,
    salted_sums,
)
from laketide.operators.joins import broadcast_if_small, changed, enrich, full_outer, not_in, orphans
from laketide.operators.windows import (
    bounded_frame,
    latest_per_key,
    prefix_sums,
    strictly_past,
    top_k_per_group,
    with_group_stats,
)
from laketide.plans.fixtures import SQL_D, SQL_I, declarations, invoices
from laketide.plans.q_basics import VERSION_SQL, order_versions
from laketide.plans.registry import query, sql_mean, sql_total, table

# ---- joins ---------------------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.withColumnRenamed("o_custkey", "c_custkey").join(c, "c_custkey")
    return joined.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query(
    "join_left_enrich",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, p_brand, s_name, n_name FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def join_left_enrich(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "p_brand")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name", "s_nationkey AS n_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    wide = enrich(table(spark, sf, "lineitem"), [(parts, "l_partkey"), (suppliers, "l_suppkey"), (nations, "n_nationkey")])
    return wide.select("l_orderkey", "l_linenumber", "l_extendedprice", "p_brand", "s_name", "n_name")


@query(
    "join_broadcast",
    f"""SELECT p_brand, {sql_total('l_extendedprice')} AS revenue, COUNT(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def join_broadcast(spark, sf):
    brands = broadcast_if_small(table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "p_brand"))
    joined = table(spark, sf, "lineitem").join(brands, "l_partkey")
    return joined.groupBy("p_brand").agg(total("l_extendedprice").alias("revenue"), F.count("*").alias("lines"))


@query(
    "join_sort_merge",
    f"""SELECT o_orderpriority, COUNT(*) AS lines, {sql_total('l_quantity')} AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
)
def join_sort_merge(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderpriority").hint("merge")
    joined = table(spark, sf, "lineitem").join(o, "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), total("l_quantity").alias("quantity"))


@query(
    "join_full_outer",
    """SELECT COALESCE(i.k, r.k) AS nation, COALESCE(issued, 0) AS issued, COALESCE(received, 0) AS received
    FROM (SELECT s_nationkey AS k, COUNT(*) AS issued FROM supplier GROUP BY 1) i
    FULL OUTER JOIN (SELECT c_nationkey AS k, COUNT(*) AS received FROM customer GROUP BY 1) r ON i.k = r.k""",
)
def join_full_outer(spark, sf):
    issued = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("issued"))
    received = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("received"))
    return full_outer([issued, received], "nation", {"issued": 0, "received": 0})


@query(
    "join_full_outer_chain",
    f"""WITH a AS (SELECT o_custkey AS id, COUNT(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS id, COUNT(*) AS low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1),
    c AS (SELECT user_id AS id, {sql_total('value')} AS minutes FROM events GROUP BY 1)
    SELECT id, COALESCE(urgent, 0) AS urgent, COALESCE(low, 0) AS low, COALESCE(minutes, 0) AS minutes FROM a FULL OUTER JOIN b USING (id) FULL OUTER JOIN c USING (id)""",
)
def join_full_outer_chain(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy("id").agg(F.count("*").alias("urgent"))
    low = o.where("o_orderpriority = '5-LOW'").groupBy("id").agg(F.count("*").alias("low"))
    minutes = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(total("value").alias("minutes"))
    return full_outer([urgent, low, minutes], "id", {"urgent": 0, "low": 0, "minutes": 0.0})


@query(
    "join_anti_orphans",
    f"""WITH {SQL_D} SELECT declaration_id, tax_id FROM d
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR), 9, '0') = d.tax_id)""",
)
def join_anti_orphans(spark, sf):
    registry = table(spark, sf, "customer")
    master = registry.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("registered"))
    return orphans(declarations(spark, sf), master, "tax_id", "registered").select("declaration_id", "tax_id")


@query(
    "subquery_not_in",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)",
)
def subquery_not_in(spark, sf):
    single = table(spark, sf, "lineitem").where("l_quantity = 1")
    return not_in(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", single, "l_partkey")


@query(
    "latest_slice",
    f"""SELECT event_type, COUNT(*) AS n, {sql_total('value')} AS total_value FROM events
    WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events) GROUP BY event_type""",
)
def latest_slice(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("lt_events")
    return spark.sql(
        """SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
        FROM lt_events WHERE ts >= (SELECT date_trunc('DAY', MAX(ts)) FROM lt_events) GROUP BY event_type"""
    )


@query(
    "join_diff_names",
    "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def join_diff_names(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")


@query(
    "join_multi_key",
    f"""WITH a AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS fy, {sql_total('o_totalprice')} AS declared FROM orders GROUP BY 1, 2),
    b AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS fy, COUNT(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
    SELECT cust, fy, declared, urgent FROM a JOIN b USING (cust, fy)""",
)
def join_multi_key(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("fy"), "o_totalprice", "o_orderpriority"
    )
    a = o.groupBy("cust", "fy").agg(total("o_totalprice").alias("declared"))
    b = o.where("o_orderpriority = '1-URGENT'").groupBy("cust", "fy").agg(F.count("*").alias("urgent"))
    return a.join(b, ["cust", "fy"])


@query(
    "changed_rows",
    f"""WITH {VERSION_SQL} SELECT v1.* FROM v1 JOIN v0 USING (o_orderkey)
    WHERE v1.o_orderstatus IS DISTINCT FROM v0.o_orderstatus OR v1.o_totalprice IS DISTINCT FROM v0.o_totalprice""",
)
def changed_rows(spark, sf):
    v0, v1 = order_versions(spark, sf)
    return changed(v1, v0, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    "repeat_vs_first",
    """WITH c AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id)
    SELECT CASE WHEN n > 65 THEN 'repeat' ELSE 'rare' END AS visitor, COUNT(*) AS total, COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS passed,
      CAST(COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS pass_rate
    FROM events JOIN c USING (user_id) GROUP BY 1""",
)
def repeat_vs_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    # outcomes are counted per user first, so the join meets one row per user on both sides
    per_user = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    visitor = F.when(F.col("n") > 65, "repeat").otherwise("rare").alias("visitor")
    rates = per_user.groupBy(visitor).agg(F.sum("n").alias("total"), F.sum("ok").alias("passed"))
    return rates.withColumn("pass_rate", percent(F.col("passed"), F.col("total")))


# ---- aggregations ----------------------------------------------------------------------------

GOLD_SQL = f"""g AS (
  SELECT o_orderpriority AS category, r_name AS region, COUNT(*) AS declarations, {sql_total('o_totalprice')} AS total_amount,
    {sql_mean('o_totalprice')} AS avg_amount, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS approved,
    COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS pending, COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS rejected
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""


@query("gold_category_region", f"WITH {GOLD_SQL} SELECT * FROM g")
def gold_category_region(spark, sf):
    return gold(spark, sf)


def customer_places(spark, sf):
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"), F.col("n_name").alias("office"))
    )


def gold(spark, sf):
    """Orders meet their region first: when customers are few enough to broadcast, orders are
    never shuffled; otherwise once, and adaptive execution splits a hot customer. The
    aggregate then sends one row per task and group."""
    status = F.col("o_orderstatus")
    placed = table(spark, sf, "orders").join(customer_places(spark, sf), "o_custkey")
    sums = placed.groupBy(F.col("o_orderpriority").alias("category"), "region").agg(
        F.count("*").alias("declarations"),
        total("o_totalprice").alias("total_amount"),
        *[F.count_if(status == s).alias(name) for s, name in (("F", "approved"), ("O", "pending"), ("P", "rejected"))],
    )
    return sums.withColumn("avg_amount", F.col("total_amount") / F.col("declarations"))


@query(
    "agg_min_max",
    """SELECT o_custkey, min(o_orderdate) AS first_filed, max(o_orderdate) AS last_filed, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year,
    min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders GROUP BY o_custkey""",
)
def agg_min_max(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_filed"),
        F.max("o_orderdate").alias("last_filed"),
        F.max(F.year("o_orderdate")).alias("last_year"),
        F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"),
    )


@query(
    "daily_kpis_global",
    f"""SELECT COUNT(*) AS declarations, {sql_total('o_totalprice')} AS total_amount, {sql_mean('o_totalprice')} AS avg_amount,
    COUNT(DISTINCT o_custkey) AS taxpayers, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS approved FROM orders""",
)
def daily_kpis_global(spark, sf):
    return table(spark, sf, "orders").agg(
        F.count("*").alias("declarations"),
        total("o_totalprice").alias("total_amount"),
        mean("o_totalprice").alias("avg_amount"),
        F.countDistinct("o_custkey").alias("taxpayers"),
        F.count_if(F.col("o_orderstatus") == "F").alias("approved"),
    )


@query(
    "agg_filter_clause",
    """SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS large_lines, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open_lines,
    MAX(l_extendedprice) FILTER (WHERE l_discount = 0) AS top_undiscounted FROM lineitem GROUP BY l_returnflag""",
)
def agg_filter_clause(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lt_lineitem_filter")
    return spark.sql(
        """SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS large_lines,
        COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open_lines,
        MAX(l_extendedprice) FILTER (WHERE l_discount = 0) AS top_undiscounted FROM lt_lineitem_filter GROUP BY l_returnflag"""
    )


@query(
    "agg_count_distinct",
    """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
)
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query(
    "null_counts",
    f"""WITH {SQL_D} SELECT COUNT(*) - COUNT(tax_id) AS tax_id, COUNT(*) - COUNT(amount) AS amount, COUNT(*) - COUNT(vat_amount) AS vat_amount,
    COUNT(*) - COUNT(status) AS status, COUNT(*) - COUNT(filed_on) AS filed_on FROM d""",
)
def null_counts_query(spark, sf):
    return null_counts(declarations(spark, sf), ["tax_id", "amount", "vat_amount", "status", "filed_on"])


@query("duplicate_keys", f"WITH {SQL_I} SELECT invoice_id, COUNT(*) AS copies FROM i GROUP BY invoice_id HAVING COUNT(*) > 1")
def duplicate_keys_query(spark, sf):
    return duplicate_keys(invoices(spark, sf), ["invoice_id"])


@query("distinct_keys", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").distinct()


@query(
    "drop_duplicates",
    """WITH p AS (SELECT CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 500 END AS id,
      CASE c_custkey % 500 % 3 WHEN 0 THEN NULL WHEN 1 THEN 'no-at' ELSE 'c' || CAST(c_custkey % 500 AS VARCHAR) || '@x' END AS email FROM customer)
    SELECT DISTINCT id, email FROM p WHERE id IS NOT NULL AND contains(email, '@')""",
)
def drop_duplicates(spark, sf):
    slot = F.col("c_custkey") % 500
    people = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 17 != 0, slot).alias("id"),
        F.when(slot % 3 == 1, "no-at").when(slot % 3 == 2, F.concat(F.lit("c"), slot.cast("string"), F.lit("@x"))).alias("email"),
    )
    return people.transform(clean_contacts)


def clean_contacts(df):
    """Whole-row duplicates, rows without an id and addresses without @ are removed."""
    return df.where(F.col("id").isNotNull() & F.col("email").contains("@")).dropDuplicates()


@query(
    "agg_of_agg",
    f"""WITH {GOLD_SQL} SELECT category, SUM(declarations)::BIGINT AS declarations, {sql_total('total_amount')} AS total_amount, COUNT(*) AS regions FROM g GROUP BY category""",
)
def agg_of_agg(spark, sf):
    return gold(spark, sf).groupBy("category").agg(
        F.sum("declarations").alias("declarations"), total("total_amount").alias("total_amount"), F.count("*").alias("regions")
    )


@query(
    "failure_pct",
    """SELECT l_linestatus AS method, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS failed, COUNT(*) AS total,
    CAST(CAST(COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) * 100.0::DOUBLE / COUNT(*) AS DECIMAL(5,2)) AS DOUBLE) AS failure_pct
    FROM lineitem GROUP BY l_linestatus""",
)
def failure_pct(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("method")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count("*").alias("total")
    )
    return counts.withColumn("failure_pct", percent(F.col("failed"), F.col("total")).cast("decimal(5,2)").cast("double"))


@query(
    "agg_expression",
    """SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.85 AS DECIMAL(4,2))) AS DOUBLE) AS net_total FROM orders GROUP BY 1""",
)
def agg_expression(spark, sf):
    net = F.expr("CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.85 AS DECIMAL(4,2))) AS DOUBLE)")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(net.alias("net_total"))


@query(
    "agg_by_month",
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, strftime(o_orderdate, '%Y-%m') AS month_name, COUNT(*) AS n,
    {sql_total('o_totalprice')} AS amount FROM orders GROUP BY 1, 2""",
)
def agg_by_month(spark, sf):
    at = F.col("o_orderdate")
    month = F.trunc(at.cast("date"), "month").alias("month_start")
    return table(spark, sf, "orders").groupBy(month, F.date_format(at, "yyyy-MM").alias("month_name")).agg(
        F.count("*").alias("n"), total("o_totalprice").alias("amount")
    )


@query(
    "exact_quantiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS q0, quantile_cont(l_extendedprice, 0.9) AS q1 FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles_query(spark, sf):
    return exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9], ["l_returnflag"])


@query(
    "describe_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS stddev,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def describe_profile(spark, sf):
    return profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "freq_of_freq",
    """SELECT n AS orders_per_customer, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY n""",
)
def freq_of_freq(spark, sf):
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders_per_customer"))
    return per_customer.groupBy("orders_per_customer").agg(F.count("*").alias("customers"))


@query(
    "salted_agg",
    f"""SELECT CASE WHEN o_orderkey % 10 < 9 THEN 0 ELSE o_custkey END AS hot_key, {sql_total('o_totalprice')} AS amount, COUNT(*) AS n FROM orders GROUP BY 1""",
)
def salted_agg(spark, sf):
    """Nine rows in ten share one key; the salted stage spreads them over tasks."""
    o = table(spark, sf, "orders")
    skewed = o.withColumn("hot_key", F.when(o.o_orderkey % 10 < 9, F.lit(0).cast("bigint")).otherwise(o.o_custkey))
    sums = salted_sums(skewed, ["hot_key"], ["o_orderkey"], {"amount": money("o_totalprice"), "n": F.lit(1)})
    return sums.withColumn("amount", F.col("amount").cast("double"))


@query(
    "salted_repartition",
    """SELECT hot_key, COUNT(*) AS rows, CAST(MAX(o_orderkey) AS BIGINT) AS last_key FROM
    (SELECT CASE WHEN o_orderkey % 10 < 9 THEN 0 ELSE o_custkey END AS hot_key, o_orderkey FROM orders) GROUP BY 1""",
)
def salted_repartition(spark, sf):
    """Repartition by (key, salt), the layout for work that cannot be pre-aggregated."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    skewed = o.withColumn("hot_key", F.when(o.o_orderkey % 10 < 9, F.lit(0).cast("bigint")).otherwise(o.o_custkey))
    spread = skewed.withColumn("salt", salt_of("o_orderkey")).repartition("hot_key", "salt")
    return spread.groupBy("hot_key").agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("last_key"))


@query(
    "skew_stats",
    """SELECT COUNT(*) AS groups, MAX(n) AS largest, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS average, MAX(n) / (CAST(SUM(n) AS DOUBLE) / COUNT(*)) AS skew_ratio
    FROM (SELECT CASE WHEN o_orderkey % 10 < 9 THEN 0 ELSE o_custkey END AS hot_key, COUNT(*) AS n FROM orders GROUP BY 1)""",
)
def skew_stats(spark, sf):
    o = table(spark, sf, "orders")
    skewed = o.select(F.when(o.o_orderkey % 10 < 9, F.lit(0).cast("bigint")).otherwise(o.o_custkey).alias("hot_key"))
    return group_skew(skewed, "hot_key")


@query(
    "salted_balance",
    "SELECT COUNT(*) AS rows, true AS three_times_smaller, true AS same_totals FROM orders",
)
def salted_balance(spark, sf):
    """The largest partition of a skewed key before and after salting, and the totals of both ways."""
    o = table(spark, sf, "orders")
    key = F.when(o.o_orderkey % 10 < 9, F.lit(0).cast("bigint")).otherwise(o.o_custkey)
    skewed = o.select(key.alias("hot_key"), "o_orderkey", money("o_totalprice").alias("amount")).withColumn("salt", salt_of("o_orderkey", salts=64))
    sizes = {}
    for name, by in (("plain", ["hot_key"]), ("salted", ["hot_key", "salt"])):
        sizes[name] = rows_per_partition(skewed.repartition(16, *by)).agg(F.max("rows")).first()[0] or 0
    plain = skewed.groupBy("hot_key").agg(F.sum("amount").alias("amount"))
    salted = skewed.groupBy("hot_key", "salt").agg(F.sum("amount").alias("amount")).groupBy("hot_key").agg(F.sum("amount").alias("amount"))
    same = plain.select("hot_key", F.col("amount").cast("decimal(38,2)")).exceptAll(salted.select("hot_key", F.col("amount").cast("decimal(38,2)"))).isEmpty()
    return o.agg(F.count("*").alias("rows")).withColumns({"three_times_smaller": F.lit(sizes["plain"] >= 3 * sizes["salted"]), "same_totals": F.lit(same)})


@query(
    "partition_balance",
    "SELECT COUNT(*) AS rows, CAST(16 AS BIGINT) AS partitions, true AS balanced, true AS keys_stay_together FROM lineitem",
)
def partition_balance(spark, sf):
    """Rows over all partitions after a repartition by key, and whether it is even and keeps keys whole."""
    dealt = table(spark, sf, "lineitem").select("l_orderkey").repartition(16, "l_orderkey")
    sizes = rows_per_partition(dealt).agg(F.sum("rows").alias("rows"), F.count("*").alias("partitions"), (F.max("rows") < 2 * F.avg("rows")).alias("balanced"))
    places = dealt.select("l_orderkey", F.spark_partition_id().alias("place")).distinct()
    whole = places.groupBy("l_orderkey").count().where("count > 1").isEmpty()
    return sizes.withColumn("keys_stay_together", F.lit(whole))


@query("partition_sizes")
def partition_sizes(spark, sf):
    """Rows per partition after a repartition by key."""
    return rows_per_partition(table(spark, sf, "lineitem").select("l_orderkey").repartition(16, "l_orderkey"))


@query(
    "pivot_matrix",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
    COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F", COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O", COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P"
    FROM orders GROUP BY 1""",
)
def pivot_matrix(spark, sf):
    by_year = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("fiscal_year"))
    return by_year.pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0, ["F", "O", "P"])


@query(
    "reconcile",
    f"""WITH {VERSION_SQL}, a AS (SELECT o_orderstatus, {sql_total('o_totalprice')} AS x FROM v0 GROUP BY 1), b AS (SELECT o_orderstatus, {sql_total('o_totalprice')} AS x FROM v1 GROUP BY 1)
    SELECT COALESCE(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, a.x AS left_value, b.x AS right_value, COALESCE(abs(a.x - b.x) < 0.01, false) AS matches
    FROM a FULL OUTER JOIN b ON a.o_orderstatus = b.o_orderstatus""",
)
def reconcile_query(spark, sf):
    a, b = (v.groupBy("o_orderstatus").agg(total("o_totalprice").alias("amount")) for v in order_versions(spark, sf))
    return reconcile(a, b, ["o_orderstatus"], "amount")


# ---- windows ---------------------------------------------------------------------------------


@query(
    "dedup_latest",
    f"""WITH {SQL_I} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
      ORDER BY issued_at DESC, issuer DESC, item DESC, order_ref DESC, net DESC, vat DESC, status DESC) AS rn FROM i) WHERE rn = 1""",
)
def dedup_latest(spark, sf):
    return latest_per_key(invoices(spark, sf), ["invoice_id"], ["issued_at"])


@query(
    "topk_per_group",
    """SELECT n_name, c_custkey, c_acctbal, CAST(rnk AS INTEGER) AS rnk, CAST(drnk AS INTEGER) AS drnk FROM (
      SELECT n_name, c_custkey, c_acctbal, rank() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC) AS rnk,
        dense_rank() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC) AS drnk
      FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rnk <= 3""",
)
def topk_per_group(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = top_k_per_group(c.select("n_name", "c_custkey", "c_acctbal"), ["n_name"], [F.desc("c_acctbal")], 3, "rank")
    return best.withColumn("drnk", F.dense_rank().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"))))


YEARLY_SQL = f"""y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fy, {sql_total('o_totalprice')} AS income FROM orders GROUP BY 1, 2)"""


def yearly(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(total("o_totalprice").alias("income"))


@query(
    "yoy_change",
    f"""WITH {YEARLY_SQL}, l AS (SELECT *, lag(income) OVER (PARTITION BY o_custkey ORDER BY fy) AS previous FROM y)
    SELECT *, CASE WHEN previous > 0 THEN (income - previous) / previous * 100.0::DOUBLE END AS yoy_pct FROM l""",
)
def yoy_change(spark, sf):
    # one row per customer and year, so a customer's window has as many rows as there are years
    w = Window.partitionBy("o_custkey").orderBy("fy")
    y = yearly(spark, sf).withColumn("previous", F.lag("income").over(w))
    change = (F.col("income") - F.col("previous")) / F.col("previous") * 100.0
    return y.withColumn("yoy_pct", F.when(F.col("previous") > 0, change))


@query(
    "lag_lead",
    """SELECT event_id, user_id, lag(event_type) OVER w AS before_type, lead(event_type) OVER w AS after_type, lag(value, 2) OVER w AS two_back
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def lag_lead(spark, sf):
    columns = {
        "before_type": lambda w: F.lag("event_type").over(w),
        "after_type": lambda w: F.lead("event_type").over(w),
        "two_back": lambda w: F.lag("value", 2).over(w),
    }
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    framed = bounded_frame(e, ["user_id"], ["ts", "event_id"], columns, F.date_trunc("minute", "ts"), before=2, after=1)
    return framed.select("event_id", "user_id", *columns)


@query(
    "running_total",
    """SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders""",
)
def running_total(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    piece = F.struct("o_orderdate", F.expr("o_orderkey div 1000000 AS key_range"))
    sums = prefix_sums(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"running": money("o_totalprice")}, piece)
    return sums.select("o_orderkey", "o_custkey", F.col("running").cast("double").alias("running"))


@query(
    "running_total_hot_key",
    """SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderkey % 10 < 9 ORDER BY o_orderdate, o_orderkey
      ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders""",
)
def running_total_hot_key(spark, sf):
    """Nine rows in ten share one key, and the two-level form is forced by the limit."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10 < 9).alias("hot"), "o_orderdate", "o_totalprice")
    piece = F.struct("o_orderdate", F.expr("o_orderkey div 1000000 AS key_range"))
    sums = prefix_sums(o, ["hot"], ["o_orderdate", "o_orderkey"], {"running": money("o_totalprice")}, piece, hot_rows=1)
    return sums.select("o_orderkey", F.col("running").cast("double").alias("running"))


PER_CUSTOMER_SQL = f"""p AS (SELECT o_custkey, r_name AS region, COUNT(*) AS declarations, {sql_total('o_totalprice')} AS total_tax,
    COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) AS rejection_rate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


@query(
    "vs_group_avg",
    f"""WITH {PER_CUSTOMER_SQL}, s AS (SELECT region, {sql_mean('total_tax')} AS region_avg FROM p GROUP BY region)
    SELECT o_custkey, p.region, declarations, total_tax, rejection_rate, region_avg, total_tax / region_avg AS vs_region, total_tax / region_avg > 1.0 AS above_region
    FROM p JOIN s ON p.region = s.region""",
)
def vs_group_avg(spark, sf):
    places = customer_places(spark, sf).drop("office")
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("declarations"),
        total("o_totalprice").alias("total_tax"),
        (F.count_if(F.col("o_orderstatus") == "P") / F.count("*").cast("double")).alias("rejection_rate"),
    )
    placed = with_group_stats(per_customer.join(places, "o_custkey"), ["region"], {"region_avg": mean("total_tax")})
    return placed.withColumn("vs_region", F.col("total_tax") / F.col("region_avg")).withColumn("above_region", F.col("vs_region") > 1.0)


@query(
    "history_features",
    """WITH per AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
    h AS (SELECT user_id, day, COALESCE(SUM(n) OVER w, 0)::BIGINT AS past_events, CAST(COALESCE(SUM(v) OVER w, 0) AS DOUBLE) AS past_value
      FROM per WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, e.user_id, past_events, past_value FROM events e JOIN h ON e.user_id = h.user_id AND CAST(e.ts AS DATE) = h.day""",
)
def history_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "value")
    sums = {"past_events": F.lit(1).cast("bigint"), "past_value": money("value")}
    past = strictly_past(e, ["user_id"], "day", sums, F.trunc("day", "month"))
    return past.select("event_id", "user_id", "past_events", F.col("past_value").cast("double").alias("past_value"))
