"""Business tables derived from the given ones, as a DataFrame and as SQL.

The given tables carry no NULLs or format errors, so defects are placed by key modulus.
Every derived table keeps all rows of the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.functions.scalars import money, nine_digit_id
from laketide.plans.registry import table

AS_OF = "2024-01-31 00:00:00"
STATUSES = ("F", "O", "P")
VAT_RATES = {"VAT24": "0.24", "VAT13": "0.13", "VAT06": "0.06", "EXEMPT": "0.00"}


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Tax declarations from ``orders`` with missing ids, short ids, negative amounts, unknown
    or padded statuses, a second date format, untrimmed names and missing tax."""
    k = F.col("o_orderkey")
    amount = F.when(k % 30 == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    group = F.element_at(F.array(*[F.lit(v) for v in VAT_RATES]), (k % 4 + 1).cast("int"))
    rate = F.element_at(F.array(*[F.lit(v).cast("decimal(4,2)") for v in VAT_RATES.values()]), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        k.alias("declaration_id"),
        F.when(k % 25 == 0, F.lit(None))
        .when(k % 40 == 1, F.lpad(F.col("o_custkey").cast("string"), 5, "0"))
        .otherwise(nine_digit_id("o_custkey"))
        .alias("tax_id"),
        F.concat(F.when(k % 20 == 5, F.lit("  Customer ")).otherwise(F.lit("Customer ")), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("category"),
        amount.alias("amount"),
        group.alias("vat_group"),
        F.when(k % 33 != 6, (money(amount) * rate).cast("double")).alias("vat_amount"),
        F.when(k % 35 == 3, F.lit("??")).when(k % 50 == 7, F.concat("o_orderstatus", F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 45 == 4, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filed_on"),
        F.col("o_orderdate").alias("filed_at"),
        F.col("o_custkey").alias("cust"),
    )


SQL_D = """d AS (
  SELECT o_orderkey AS declaration_id,
    CASE WHEN o_orderkey % 25 = 0 THEN NULL
         WHEN o_orderkey % 40 = 1 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0')
         ELSE lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS tax_id,
    CASE WHEN o_orderkey % 20 = 5 THEN '  Customer ' ELSE 'Customer ' END || CAST(o_custkey AS VARCHAR) AS name,
    o_orderpriority AS category,
    CASE WHEN o_orderkey % 30 = 2 THEN -o_totalprice ELSE o_totalprice END AS amount,
    CASE o_orderkey % 4 WHEN 0 THEN 'VAT24' WHEN 1 THEN 'VAT13' WHEN 2 THEN 'VAT06' ELSE 'EXEMPT' END AS vat_group,
    CASE WHEN o_orderkey % 33 <> 6 THEN CAST(
      CAST(CASE WHEN o_orderkey % 30 = 2 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2))
      * CAST(CASE o_orderkey % 4 WHEN 0 THEN 0.24 WHEN 1 THEN 0.13 WHEN 2 THEN 0.06 ELSE 0.00 END AS DECIMAL(4,2)) AS DOUBLE) END AS vat_amount,
    CASE WHEN o_orderkey % 35 = 3 THEN '??' WHEN o_orderkey % 50 = 7 THEN o_orderstatus || ' ' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 45 = 4 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filed_on,
    o_orderdate AS filed_at,
    o_custkey AS cust
  FROM orders)"""


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices from ``lineitem``; ``(l_orderkey, l_linenumber)`` repeats, so ids do too."""
    status = F.when(F.col("l_returnflag") == "A", "Submitted").when(F.col("l_returnflag") == "N", "Pending").otherwise("Cancelled")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("invoice_id"),
        F.col("l_suppkey").alias("issuer"),
        F.col("l_partkey").alias("item"),
        F.col("l_orderkey").alias("order_ref"),
        F.col("l_extendedprice").alias("net"),
        (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).cast("double").alias("vat"),
        status.alias("status"),
        F.col("l_shipdate").alias("issued_at"),
    )


SQL_I = """i AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS invoice_id,
    l_suppkey AS issuer, l_partkey AS item, l_orderkey AS order_ref, l_extendedprice AS net,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE) AS vat,
    CASE l_returnflag WHEN 'A' THEN 'Submitted' WHEN 'N' THEN 'Pending' ELSE 'Cancelled' END AS status,
    l_shipdate AS issued_at
  FROM lineitem)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run log from ``events``; every fiftieth run has not finished."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "FAILED").when(kind == "signup", "TIMEDOUT").when(kind == "view", "CANCELED").otherwise("SUCCEEDED")
    length = F.make_dt_interval(secs=F.floor("value"))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("job_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts") + length).alias("finished_at"),
        state.alias("state"),
        F.col("value").alias("duration_s"),
    )


SQL_R = """r AS (
  SELECT user_id % 10 AS job_id, event_id AS run_id, ts AS started_at,
    CASE WHEN event_id % 50 <> 0 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'TIMEDOUT' WHEN 'view' THEN 'CANCELED' ELSE 'SUCCEEDED' END AS state,
    value AS duration_s
  FROM events)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Job list from ``nation`` and ``region``; most jobs have no run, some are deleted."""
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    gone = F.when(F.col("n_nationkey") % 7 == 6, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return named.select(
        F.col("n_nationkey").cast("bigint").alias("job_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("owner"),
        gone.alias("deleted_at"),
    )


SQL_J = """j AS (
  SELECT CAST(n_nationkey AS BIGINT) AS job_id, n_name AS name, r_name AS owner,
    CASE WHEN n_nationkey % 7 = 6 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day of the run log, with the day's state and share of failed runs."""
    r = runs(spark, sf)
    day = r.groupBy(F.col("started_at").cast("date").alias("run_date")).agg(
        F.count("*").alias("rows_ingested"),
        F.count_if(F.col("state") == "FAILED").alias("rows_quarantined"),
        F.sum(money("duration_s")).cast("double").alias("duration_s"),
    )
    share = F.col("rows_quarantined").cast("double") * 100.0 / F.col("rows_ingested")
    return day.withColumn("invalid_pct", share).withColumn("state", F.when(share > 22.0, "FAILED").otherwise("SUCCEEDED"))


SQL_DAILY = (
    SQL_R
    + """, dr0 AS (
  SELECT CAST(started_at AS DATE) AS run_date, COUNT(*) AS rows_ingested,
    COUNT(CASE WHEN state = 'FAILED' THEN 1 END) AS rows_quarantined,
    CAST(SUM(CAST(duration_s AS DECIMAL(18,2))) AS DOUBLE) AS duration_s
  FROM r GROUP BY 1),
dr AS (
  SELECT *, CAST(rows_quarantined AS DOUBLE) * 100.0::DOUBLE / rows_ingested AS invalid_pct,
    CASE WHEN CAST(rows_quarantined AS DOUBLE) * 100.0::DOUBLE / rows_ingested > 22.0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state
  FROM dr0)"""
)
