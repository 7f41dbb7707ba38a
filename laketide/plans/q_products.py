"""Data products built from several operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from laketide.functions.scalars import mean, money, percent, total
from laketide.operators import quality as dq
from laketide.operators.features import active_labels, risk_score, tier
from laketide.operators.joins import enrich, side_by_side
from laketide.operators.windows import latest_per_key, top_n_ranked
from laketide.plans.fixtures import SQL_D, SQL_I, declarations, invoices
from laketide.plans.medallion import Medallion
from laketide.plans.q_changes import SCD_SQL, scd_dimension
from laketide.plans.q_relational import customer_places
from laketide.plans.registry import query, sql_mean, sql_total, table
from laketide.session import fresh_dir

LATEST_INVOICE_SQL = f"""{SQL_I}, c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
    ORDER BY issued_at DESC, issuer DESC, item DESC, order_ref DESC, net DESC, vat DESC, status DESC) AS rn FROM i WHERE net >= 1000) WHERE rn = 1)"""


def vat_total(c):
    return F.sum(F.col(c).cast("decimal(20,4)")).cast("double")


@query(
    "gold_sector_region",
    f"""WITH {LATEST_INVOICE_SQL} SELECT p_type AS sector, r_name AS region, COUNT(*) AS invoice_count, {sql_total('net')} AS total_net,
    CAST(SUM(CAST(vat AS DECIMAL(20,4))) AS DOUBLE) AS total_vat, {sql_mean('net')} AS avg_net, COUNT(CASE WHEN status = 'Submitted' THEN 1 END) AS submitted,
    COUNT(CASE WHEN status = 'Cancelled' THEN 1 END) AS cancelled, COUNT(CASE WHEN status = 'Pending' THEN 1 END) AS pending
    FROM c LEFT JOIN part ON item = p_partkey LEFT JOIN supplier ON issuer = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def gold_sector_region(spark, sf):
    """Deduplicated invoices, enriched with sector and region, nine measures."""
    clean = latest_per_key(invoices(spark, sf).where("net >= 1000"), ["invoice_id"], ["issued_at"])
    sectors = table(spark, sf, "part").selectExpr("p_partkey AS item", "p_type AS sector")
    places = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("s_suppkey").alias("issuer"), F.col("r_name").alias("region"))
    )
    wide = enrich(clean, [(sectors, "item"), (places, "issuer")])
    return wide.groupBy("sector", "region").agg(
        F.count("*").alias("invoice_count"),
        total("net").alias("total_net"),
        vat_total("vat").alias("total_vat"),
        mean("net").alias("avg_net"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Submitted", "Cancelled", "Pending")],
    )


@query(
    "gold_payments",
    f"""WITH {SQL_D}, c AS (SELECT cust, filed_at, category AS method, vat_group AS channel, amount, declaration_id, CASE WHEN status IN ('F', 'O', 'P') THEN status ELSE 'UNKNOWN' END AS status FROM d WHERE tax_id IS NOT NULL AND amount > 0),
    u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cust, method ORDER BY filed_at DESC, declaration_id DESC) AS rn FROM c) WHERE rn = 1)
    SELECT method, channel, COUNT(*) AS payments, {sql_total('amount')} AS total_amount, {sql_mean('amount')} AS avg_amount, COUNT(CASE WHEN status = 'F' THEN 1 END) AS confirmed,
    COUNT(CASE WHEN status = 'P' THEN 1 END) AS failed, COUNT(CASE WHEN status = 'O' THEN 1 END) AS pending, COUNT(CASE WHEN status = 'UNKNOWN' THEN 1 END) AS unknown,
    CAST(COUNT(CASE WHEN status = 'P' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS failure_pct FROM u GROUP BY 1, 2""",
)
def gold_payments(spark, sf):
    """The status is normalized without trimming, so a padded one becomes UNKNOWN."""
    rows = declarations(spark, sf).where("tax_id IS NOT NULL AND amount > 0").select(
        "cust", "filed_at", F.col("category").alias("method"), F.col("vat_group").alias("channel"), "amount", "declaration_id",
        F.when(F.col("status").isin("F", "O", "P"), F.col("status")).otherwise("UNKNOWN").alias("status"),
    )
    last = latest_per_key(rows, ["cust", "method"], ["filed_at", "declaration_id"])
    names = {"F": "confirmed", "P": "failed", "O": "pending", "UNKNOWN": "unknown"}
    sums = last.groupBy("method", "channel").agg(
        F.count("*").alias("payments"),
        total("amount").alias("total_amount"),
        mean("amount").alias("avg_amount"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()],
    )
    return sums.withColumn("failure_pct", percent(F.col("failed"), F.col("payments")))


# ---- one row per taxpayer -------------------------------------------------------------------------

AGGREGATES_SQL = f"""tax AS (SELECT o_custkey AS id, COUNT(*) AS declarations, {sql_total('o_totalprice')} AS tax_paid, CAST(MAX(year(o_orderdate)) AS INTEGER) AS last_year FROM orders GROUP BY 1),
  social AS (SELECT o_custkey AS id, {sql_total('o_totalprice')} AS contributions FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
  services AS (SELECT user_id AS id, COUNT(*) AS service_events, {sql_mean('value')} AS avg_minutes FROM events GROUP BY 1),
  bills AS (SELECT o_custkey AS id, COUNT(*) AS invoices, {sql_total('l_extendedprice')} AS invoiced FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def taxpayer_aggregates(spark, sf):
    """Four aggregates per taxpayer. Invoice lines are summed per order before the join."""
    o = table(spark, sf, "orders")
    tax = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("declarations"), total("o_totalprice").alias("tax_paid"), F.max(F.year("o_orderdate")).alias("last_year")
    )
    social = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(
        total("o_totalprice").alias("contributions")
    )
    services = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("service_events"), mean("value").alias("avg_minutes")
    )
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("net"))
    owners = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    bills = per_order.join(owners, "l_orderkey").groupBy("id").agg(
        F.sum("n").alias("invoices"), F.sum("net").cast("double").alias("invoiced")
    )
    return tax, social, services, bills


MEASURES = {"declarations": 0, "tax_paid": 0.0, "contributions": 0.0, "service_events": 0, "avg_minutes": 0.0, "invoices": 0, "invoiced": 0.0}
FILLED_SQL = ", ".join(f"COALESCE({m}, 0) AS {m}" for m in MEASURES)
LEFT_SQL = f"""{AGGREGATES_SQL}, c360 AS (SELECT c_custkey AS id, c_name AS full_name, n_name AS region, last_year, {FILLED_SQL} FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN tax t ON c_custkey = t.id LEFT JOIN social s ON c_custkey = s.id LEFT JOIN services v ON c_custkey = v.id LEFT JOIN bills b ON c_custkey = b.id)"""


def citizens(spark, sf):
    registry = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("n_name").alias("region"))
    )
    return enrich(registry, [(a, "id") for a in taxpayer_aggregates(spark, sf)]).fillna(MEASURES)


@query("citizen_360_left", f"WITH {LEFT_SQL} SELECT * FROM c360")
def citizen_360_left(spark, sf):
    return citizens(spark, sf)


@query(
    "citizen_360_full",
    f"WITH {AGGREGATES_SQL} SELECT id, last_year, {FILLED_SQL} FROM tax FULL OUTER JOIN social USING (id) FULL OUTER JOIN services USING (id) FULL OUTER JOIN bills USING (id)",
)
def citizen_360_full(spark, sf):
    return side_by_side(list(taxpayer_aggregates(spark, sf)), "id", MEASURES)


@query(
    "risk_score",
    f"""WITH {LEFT_SQL}, s AS (SELECT id, tax_paid, contributions, service_events, invoices, CASE WHEN tax_paid > 2000000 THEN 1 ELSE 0 END + CASE WHEN contributions = 0 AND tax_paid > 0 THEN 1 ELSE 0 END
      + CASE WHEN service_events > 5 THEN 1 ELSE 0 END + CASE WHEN invoices > 10 AND tax_paid < 1000 THEN 2 ELSE 0 END AS risk_score FROM c360)
    SELECT *, CASE WHEN risk_score >= 3 THEN 'high' WHEN risk_score >= 1 THEN 'medium' ELSE 'low' END AS risk_tier FROM s""",
)
def risk_score_query(spark, sf):
    tax, social = F.col("tax_paid"), F.col("contributions")
    points = [
        (tax > 2000000, 1),
        ((social == 0) & (tax > 0), 1),
        (F.col("service_events") > 5, 1),
        ((F.col("invoices") > 10) & (tax < 1000), 2),
    ]
    scored = citizens(spark, sf).select("id", "tax_paid", "contributions", "service_events", "invoices", risk_score(points).alias("risk_score"))
    return scored.withColumn("risk_tier", tier(F.col("risk_score"), [(3, "high"), (1, "medium")], "low"))


@query(
    "active_systems",
    f"""WITH {LEFT_SQL}, a AS (SELECT list_filter([CASE WHEN tax_paid > 0 THEN 'tax' END, CASE WHEN contributions > 0 THEN 'social' END, CASE WHEN service_events > 0 THEN 'services' END,
      CASE WHEN invoices > 0 THEN 'invoices' END, 'registry'], lambda x: x IS NOT NULL) AS systems FROM c360)
    SELECT CAST(len(systems) AS INTEGER) AS systems_count, array_to_string(systems, ',') AS systems, COUNT(*) AS citizens FROM a GROUP BY 1, 2""",
)
def active_systems(spark, sf):
    flags = {
        "tax": F.col("tax_paid") > 0,
        "social": F.col("contributions") > 0,
        "services": F.col("service_events") > 0,
        "invoices": F.col("invoices") > 0,
        "registry": F.lit(True),
    }
    labelled = citizens(spark, sf).select(active_labels(flags).alias("s"))
    grouped = labelled.groupBy(F.size("s").alias("systems_count"), F.array_join("s", ",").alias("systems"))
    return grouped.agg(F.count("*").alias("citizens"))


@query(
    "audit_priority_top100",
    f"""WITH {AGGREGATES_SQL}, r AS (SELECT o_custkey AS id, MIN(o_orderpriority) AS category FROM orders GROUP BY 1),
    s AS (SELECT tax.id, category, tax_paid AS declared, COALESCE(invoices, 0) AS invoices, COALESCE(invoiced, 0) AS invoiced, CASE WHEN tax_paid > 0 THEN COALESCE(invoiced, 0) / tax_paid ELSE 0 END AS suspect_score
      FROM tax JOIN r ON tax.id = r.id LEFT JOIN bills ON tax.id = bills.id)
    SELECT *, CAST(row_number() OVER (ORDER BY suspect_score DESC, id) AS INTEGER) AS audit_rank FROM s ORDER BY audit_rank LIMIT 100""",
)
def audit_priority_top100(spark, sf):
    """Invoiced against declared; the hundred highest ratios. The category is the smallest of
    the taxpayer's, so a re-run picks the same one."""
    tax, _, _, bills = taxpayer_aggregates(spark, sf)
    category = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("category"))
    both = tax.join(category, "id").join(bills, "id", "left").fillna({"invoices": 0, "invoiced": 0.0})
    score = F.when(F.col("tax_paid") > 0, F.col("invoiced") / F.col("tax_paid")).otherwise(F.lit(0.0))
    scored = both.select("id", "category", F.col("tax_paid").alias("declared"), "invoices", "invoiced", score.alias("suspect_score"))
    return top_n_ranked(scored, [F.desc("suspect_score"), F.col("id")], 100, "audit_rank")


# ---- daily and office reports ------------------------------------------------------------------------


@query(
    "daily_kpis",
    f"""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS declarations, {sql_total('o_totalprice')} AS tax_collected FROM orders GROUP BY 1),
    k AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS service_events, {sql_mean('value')} AS avg_minutes FROM events GROUP BY 1),
    b AS (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS invoices, {sql_total('l_extendedprice')} AS invoiced FROM lineitem GROUP BY 1)
    SELECT day, COALESCE(declarations, 0) AS declarations, COALESCE(tax_collected, 0) AS tax_collected, COALESCE(service_events, 0) AS service_events, COALESCE(avg_minutes, 0) AS avg_minutes,
    COALESCE(invoices, 0) AS invoices, COALESCE(invoiced, 0) AS invoiced FROM t FULL OUTER JOIN k USING (day) FULL OUTER JOIN b USING (day)""",
)
def daily_kpis(spark, sf):
    """Each source is reduced to one row a day before they are put side by side."""

    def daily(name, at, *measures):
        return table(spark, sf, name).groupBy(F.col(at).cast("date").alias("day")).agg(*measures)

    frames = [
        daily("orders", "o_orderdate", F.count("*").alias("declarations"), total("o_totalprice").alias("tax_collected")),
        daily("events", "ts", F.count("*").alias("service_events"), mean("value").alias("avg_minutes")),
        daily("lineitem", "l_shipdate", F.count("*").alias("invoices"), total("l_extendedprice").alias("invoiced")),
    ]
    fill = {"declarations": 0, "tax_collected": 0.0, "service_events": 0, "avg_minutes": 0.0, "invoices": 0, "invoiced": 0.0}
    return side_by_side(frames, "day", fill)


@query(
    "kpi_office_month",
    f"""WITH {SCD_SQL} SELECT c_nationkey AS office, CAST(date_trunc('month', valid_from) AS DATE) AS month_start, COUNT(*) AS taxpayers,
    COUNT(CASE WHEN c_mktsegment = 'LATE' THEN 1 END) AS late, CAST(MAX(version) AS INTEGER) AS max_version FROM dim WHERE is_current GROUP BY 1, 2""",
)
def kpi_office_month(spark, sf):
    month = F.trunc(F.col("valid_from").cast("date"), "month").alias("month_start")
    current = scd_dimension(spark, sf).where("is_current")
    return current.groupBy(F.col("c_nationkey").alias("office"), month).agg(
        F.count("*").alias("taxpayers"), F.count_if(F.col("c_mktsegment") == "LATE").alias("late"), F.max("version").alias("max_version")
    )


@query(
    "dashboard_office",
    f"SELECT n_name AS office, COUNT(*) AS declarations, {sql_total('o_totalprice')} AS amount, MAX(o_orderdate) AS last_filed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def dashboard_office(spark, sf):
    placed = table(spark, sf, "orders").join(customer_places(spark, sf).drop("region"), "o_custkey")
    return placed.groupBy("office").agg(
        F.count("*").alias("declarations"), total("o_totalprice").alias("amount"), F.max("o_orderdate").alias("last_filed")
    )


@query(
    "sensor_stats",
    f"SELECT user_id AS sensor_id, COUNT(*) AS readings, {sql_mean('value')} AS avg_value, MAX(value) AS max_value, MAX(ts) AS last_seen FROM events GROUP BY 1",
)
def sensor_stats(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("sensor_id")).agg(
        F.count("*").alias("readings"), mean("value").alias("avg_value"), F.max("value").alias("max_value"), F.max("ts").alias("last_seen")
    )


# ---- the layers as one batch ----------------------------------------------------------------------------


def medallion_run(spark, sf) -> Medallion:
    """Two loads of orders: the older years first, then all rows again as an upsert."""
    flow = Medallion(
        spark=spark,
        root=fresh_dir(spark, "medallion"),
        rules=[dq.Rule("id_present", F.col("tax_id").isNull()), dq.Rule("amount_positive", F.col("amount") < 0)],
        keys=["declaration_id"],
        newest_by=["filed_at"],
        clean=lambda df: df.withColumn("name", F.trim("name")),
        publish=lambda df: df.groupBy("category", "vat_group").agg(F.count("*").alias("n"), total("amount").alias("amount")),
        limit_pct=20.0,
    )
    rows = declarations(spark, sf).select("declaration_id", "tax_id", "name", "category", "vat_group", "amount", "filed_at")
    early = F.col("filed_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    flow.run(rows.where(early), "run-1", datetime(2024, 1, 1))
    flow.run(rows, "run-2", datetime(2024, 1, 2))
    return flow


@query(
    "medallion_batch",
    f"WITH {SQL_D} SELECT category, vat_group, COUNT(*) AS n, {sql_total('amount')} AS amount FROM d WHERE tax_id IS NOT NULL AND amount >= 0 GROUP BY 1, 2",
)
def medallion_batch(spark, sf):
    return medallion_run(spark, sf).gold.read()


@query(
    "medallion_log",
    f"""WITH {SQL_D}, l AS (SELECT 'run-1' AS run_id, COUNT(*) AS rows_read, COUNT(CASE WHEN tax_id IS NULL OR amount < 0 THEN 1 END) AS rows_quarantined FROM d WHERE filed_at < TIMESTAMP '1998-01-01 00:00:00'
      UNION ALL SELECT 'run-2', COUNT(*), COUNT(CASE WHEN tax_id IS NULL OR amount < 0 THEN 1 END) FROM d)
    SELECT run_id, 'SUCCESS' AS status, rows_read, rows_read - rows_quarantined AS rows_valid, rows_quarantined FROM l""",
)
def medallion_log(spark, sf):
    return medallion_run(spark, sf).log().select("run_id", "status", "rows_read", "rows_valid", "rows_quarantined")
