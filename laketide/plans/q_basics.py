"""Projections, predicates, scalar functions, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions import masking
from laketide.functions.scalars import (
    ID_PATTERN,
    ISO_DATE_PATTERN,
    any_of,
    first_reason,
    money,
    normalize_category,
    parse_date,
)
from laketide.operators.monitoring import severity_rank
from laketide.operators.quality import layer_reconciliation
from laketide.operators.sets import labelled_counts, two_way_difference, union_by_name
from laketide.plans.fixtures import SQL_D, STATUSES, VAT_RATES, declarations
from laketide.plans.registry import query, table

# ---- projections -----------------------------------------------------------------------


@query(
    "canonical_projection",
    """SELECT o_orderkey AS declaration_id, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS tax_id,
    CAST(o_orderdate AS DATE) AS filed_on, CAST(o_totalprice AS DOUBLE) AS amount,
    CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_orderpriority AS category, o_orderstatus AS status FROM orders""",
)
def canonical_projection(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("declaration_id"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("tax_id"),
        F.col("o_orderdate").cast("date").alias("filed_on"),
        F.col("o_totalprice").cast("double").alias("amount"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "select_expr",
    "SELECT max(o_orderkey) AS last_key, min(o_orderdate) AS first_day, max(o_totalprice) - min(o_totalprice) AS spread FROM orders",
)
def select_expr(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "max(o_orderkey) AS last_key", "min(o_orderdate) AS first_day", "max(o_totalprice) - min(o_totalprice) AS spread"
    )


# ---- predicates ------------------------------------------------------------------------


@query(
    "predicate_mix",
    f"""WITH {SQL_D} SELECT declaration_id, tax_id, name, amount, status FROM d
    WHERE tax_id IS NOT NULL AND amount BETWEEN 1000 AND 250000 AND status IN ('F', 'O', 'P') AND name = trim(name)
      AND NOT (vat_amount IS NULL) AND declaration_id <> cust""",
)
def predicate_mix(spark, sf):
    return (
        declarations(spark, sf)
        .where(F.col("tax_id").isNotNull() & F.col("amount").between(1000, 250000))
        .where(F.col("status").isin(*STATUSES) & (F.col("name") == F.trim("name")))
        .where(~F.col("vat_amount").isNull() & (F.col("declaration_id") != F.col("cust")))
        .select("declaration_id", "tax_id", "name", "amount", "status")
    )


@query(
    "predicate_regex",
    f"""WITH {SQL_D} SELECT declaration_id, tax_id, filed_on FROM d
    WHERE (tax_id IS NOT NULL AND NOT regexp_matches(tax_id, '^[0-9]{{9}}$')) OR NOT regexp_matches(filed_on, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')""",
)
def predicate_regex(spark, sf):
    bad_id = F.col("tax_id").isNotNull() & ~F.col("tax_id").rlike(ID_PATTERN)
    bad_date = ~F.col("filed_on").rlike(ISO_DATE_PATTERN)
    return declarations(spark, sf).where(bad_id | bad_date).select("declaration_id", "tax_id", "filed_on")


@query(
    "predicate_ratio",
    f"""WITH {SQL_D} SELECT declaration_id, vat_amount / amount AS ratio FROM d
    WHERE amount <> 0 AND vat_amount / amount BETWEEN 0.1 AND 0.2""",
)
def predicate_ratio(spark, sf):
    ratio = F.try_divide("vat_amount", "amount")
    return declarations(spark, sf).select("declaration_id", ratio.alias("ratio")).where(F.col("ratio").between(0.1, 0.2))


ISSUE_SQL = """tax_id IS NULL AS has_null_id,
    tax_id IS NOT NULL AND NOT regexp_matches(tax_id, '^[0-9]{9}$') AS has_bad_id,
    amount < 0 AS has_negative_amount,
    NOT regexp_matches(filed_on, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS has_bad_date,
    status NOT IN ('F', 'O', 'P') AS has_invalid_status"""


def issue_columns():
    return {
        "has_null_id": F.col("tax_id").isNull(),
        "has_bad_id": F.col("tax_id").isNotNull() & ~F.col("tax_id").rlike(ID_PATTERN),
        "has_negative_amount": F.col("amount") < 0,
        "has_bad_date": ~F.col("filed_on").rlike(ISO_DATE_PATTERN),
        "has_invalid_status": ~F.col("status").isin(*STATUSES),
    }


@query(
    "issue_flags",
    f"""WITH {SQL_D}, f AS (SELECT declaration_id, {ISSUE_SQL} FROM d)
    SELECT *, has_null_id OR has_bad_id OR has_negative_amount OR has_bad_date OR has_invalid_status AS has_any_issue FROM f""",
)
def issue_flags(spark, sf):
    flags = issue_columns()
    flagged = declarations(spark, sf).withColumns(flags)
    return flagged.select("declaration_id", *flags, any_of(map(F.col, flags)).alias("has_any_issue"))


@query(
    "case_mapping",
    f"""WITH {SQL_D} SELECT declaration_id, vat_group,
    CASE vat_group WHEN 'VAT24' THEN 0.24::DOUBLE WHEN 'VAT13' THEN 0.13::DOUBLE WHEN 'VAT06' THEN 0.06::DOUBLE WHEN 'EXEMPT' THEN 0.0::DOUBLE END AS vat_rate FROM d""",
)
def case_mapping(spark, sf):
    rate = F.lit(None).cast("double")
    for name, value in VAT_RATES.items():
        rate = F.when(F.col("vat_group") == name, F.lit(float(value))).otherwise(rate)
    return declarations(spark, sf).select("declaration_id", "vat_group", rate.alias("vat_rate"))


@query(
    "normalize_category",
    f"""WITH {SQL_D} SELECT declaration_id, status, CASE WHEN status IN ('F', 'O', 'P') THEN status ELSE 'UNKNOWN' END AS status_norm FROM d""",
)
def normalize(spark, sf):
    return declarations(spark, sf).select("declaration_id", "status", normalize_category("status", STATUSES).alias("status_norm"))


@query(
    "safe_parse_dates",
    f"""WITH {SQL_D} SELECT declaration_id, filed_on,
    CAST(try_strptime(filed_on, '%Y-%m-%d') AS DATE) AS iso_date,
    CAST(COALESCE(try_strptime(filed_on, '%Y-%m-%d'), try_strptime(filed_on, '%Y/%m/%d')) AS DATE) AS any_date,
    TRY_CAST(tax_id AS BIGINT) AS id_number FROM d""",
)
def safe_parse_dates(spark, sf):
    return declarations(spark, sf).select(
        "declaration_id",
        "filed_on",
        F.try_to_date("filed_on", "yyyy-MM-dd").alias("iso_date"),
        parse_date("filed_on").alias("any_date"),
        F.col("tax_id").try_cast("bigint").alias("id_number"),
    )


# ---- scalar functions --------------------------------------------------------------------


@query(
    "fn_string_basic",
    f"""WITH {SQL_D} SELECT declaration_id, trim(name) AS trimmed, upper(trim(name)) AS up, lower(name) AS low,
    CAST(length(name) AS INTEGER) AS len FROM d""",
)
def fn_string_basic(spark, sf):
    return declarations(spark, sf).select(
        "declaration_id",
        F.trim("name").alias("trimmed"),
        F.upper(F.trim("name")).alias("up"),
        F.lower("name").alias("low"),
        F.length("name").alias("len"),
    )


@query(
    "fn_string_concat",
    f"""WITH {SQL_D} SELECT declaration_id, tax_id || ':' || status AS joined,
    concat_ws('|', tax_id, category, status) AS joined_ws FROM d""",
)
def fn_string_concat(spark, sf):
    return declarations(spark, sf).select(
        "declaration_id",
        F.concat("tax_id", F.lit(":"), "status").alias("joined"),
        F.concat_ws("|", "tax_id", "category", "status").alias("joined_ws"),
    )


@query(
    "fn_regexp",
    f"""WITH {SQL_D} SELECT declaration_id, replace(filed_on, '/', '-') AS iso_text, filed_on LIKE '%/%' AS slashed,
    contains(category, 'HIGH') AS is_high, regexp_replace(category, '^[0-9]-', '') AS category_name FROM d""",
)
def fn_regexp(spark, sf):
    return declarations(spark, sf).select(
        "declaration_id",
        F.regexp_replace("filed_on", "/", "-").alias("iso_text"),
        F.col("filed_on").like("%/%").alias("slashed"),
        F.col("category").contains("HIGH").alias("is_high"),
        F.regexp_replace("category", "^[0-9]-", "").alias("category_name"),
    )


@query(
    "fn_math",
    """SELECT o_orderkey AS id, o_orderkey % 16 AS bucket, abs(o_totalprice - 250000) AS distance,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.85 AS DECIMAL(4,2)) AS DOUBLE) AS net,
    round(ln(o_totalprice), 6) AS log_price, CAST(floor(o_totalprice) AS BIGINT) AS whole, round(o_totalprice / 7, 6) AS share
    FROM orders""",
)
def fn_math(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 16).alias("bucket"),
        F.abs(price - 250000).alias("distance"),
        (money(price) * F.lit("0.85").cast("decimal(4,2)")).cast("double").alias("net"),
        F.round(F.log(price), 6).alias("log_price"),
        F.floor(price).alias("whole"),
        F.round(price / 7, 6).alias("share"),
    )


@query(
    "fn_date_math",
    """SELECT event_id, CAST(ts AS DATE) + 30 AS in_30_days, CAST(ts AS DATE) - 7 AS week_before,
    CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS INTEGER) AS days_left,
    CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS minutes_left,
    CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1000000) AS BIGINT) AS seconds_in,
    ts + INTERVAL 36 HOUR AS later FROM events""",
)
def fn_date_math(spark, sf):
    seconds_in = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id",
        F.date_add(F.col("ts").cast("date"), 30).alias("in_30_days"),
        F.date_sub(F.col("ts").cast("date"), 7).alias("week_before"),
        F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")).alias("days_left"),
        F.timestamp_diff("MINUTE", F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("minutes_left"),
        seconds_in.alias("seconds_in"),
        (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("later"),
    )


@query(
    "fn_date_parts",
    """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
    CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
    CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders""",
)
def fn_date_parts(spark, sf):
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.year(at).alias("y"),
        F.month(at).alias("m"),
        F.dayofmonth(at).alias("d"),
        F.dayofweek(at).alias("dow"),
        F.hour(at).alias("h"),
    )


@query(
    "fn_conditional",
    f"""WITH {SQL_D} SELECT declaration_id, COALESCE(tax_id, 'MISSING') AS id_or_missing, NULLIF(status, '??') AS known_status,
    vat_amount IS NULL AS vat_missing,
    CASE WHEN amount < 0 THEN 'negative' WHEN amount < 100000 THEN 'small' ELSE 'large' END AS size,
    CASE WHEN tax_id IS NULL THEN 'NULL_ID' WHEN length(tax_id) <> 9 THEN 'BAD_ID' WHEN amount < 0 THEN 'NEGATIVE' END AS reason FROM d""",
)
def fn_conditional(spark, sf):
    size = F.when(F.col("amount") < 0, "negative").when(F.col("amount") < 100000, "small").otherwise("large")
    return declarations(spark, sf).select(
        "declaration_id",
        F.coalesce("tax_id", F.lit("MISSING")).alias("id_or_missing"),
        F.nullif(F.col("status"), F.lit("??")).alias("known_status"),
        F.col("vat_amount").isNull().alias("vat_missing"),
        size.alias("size"),
        first_reason(
            {"NULL_ID": F.col("tax_id").isNull(), "BAD_ID": F.length("tax_id") != 9, "NEGATIVE": F.col("amount") < 0}
        ).alias("reason"),
    )


# ---- sort, limit, top-n --------------------------------------------------------------------


@query(
    "topn_orders",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def topn_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "severity_sorted",
    """SELECT event_id, severity FROM (SELECT event_id, CASE WHEN value > 300 THEN 'critical' WHEN value > 200 THEN 'warning' ELSE 'info' END AS severity
      FROM events WHERE event_type = 'error') ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, event_id""",
)
def severity_sorted(spark, sf):
    """All open alerts (errors), the most severe first; a range-partitioned sort."""
    v = F.col("value")
    severity = F.when(v > 300, "critical").when(v > 200, "warning").otherwise("info")
    open_alerts = table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", severity.alias("severity"))
    return open_alerts.orderBy(severity_rank(F.col("severity")), "event_id")


@query(
    "sort_nulls_last",
    f"""WITH {SQL_D} SELECT declaration_id, tax_id FROM d ORDER BY tax_id NULLS LAST, declaration_id""",
)
def sort_nulls_last(spark, sf):
    return declarations(spark, sf).select("declaration_id", "tax_id").orderBy(F.asc_nulls_last("tax_id"), "declaration_id")


# ---- set operations ----------------------------------------------------------------------


@query(
    "union_by_name",
    """SELECT c_custkey AS party, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""",
)
def union_all_by_name(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS party", "c_acctbal AS balance", "c_mktsegment AS segment", "'customer' AS kind")
    s = table(spark, sf, "supplier").selectExpr("'supplier' AS kind", "s_suppkey AS party", "s_acctbal AS balance")
    return union_by_name([c, s])


@query(
    "layer_counts",
    f"""WITH {SQL_D}, f AS (SELECT *, {ISSUE_SQL} FROM d),
    b AS (SELECT COUNT(*) AS n FROM f),
    s AS (SELECT COUNT(*) AS n FROM f WHERE NOT (has_null_id OR has_bad_id OR has_negative_amount OR has_bad_date OR has_invalid_status)),
    q AS (SELECT COUNT(*) AS n FROM f WHERE has_null_id OR has_bad_id OR has_negative_amount OR has_bad_date OR has_invalid_status)
    SELECT layer, n AS rows, CAST((SELECT n FROM b) - n AS DOUBLE) * 100.0::DOUBLE / (SELECT n FROM b) AS drop_pct
    FROM (SELECT 'bronze' AS layer, n FROM b UNION ALL SELECT 'silver', n FROM s UNION ALL SELECT 'quarantine', n FROM q)""",
)
def layer_counts(spark, sf):
    bad = any_of(issue_columns().values())
    return layer_reconciliation(declarations(spark, sf), {"bronze": F.lit(True), "silver": ~bad, "quarantine": bad}, "bronze")


@query(
    "table_counts",
    """SELECT 'orders' AS layer, COUNT(*) AS rows FROM orders UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
    UNION ALL SELECT 'events', COUNT(*) FROM events""",
)
def table_counts(spark, sf):
    return labelled_counts({n: table(spark, sf, n) for n in ("orders", "lineitem", "events")})


VERSION_SQL = """v0 AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
    v1 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
           FROM orders WHERE o_orderkey % 14 <> 3
           UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 = 9)"""


def order_versions(spark, sf):
    """Two versions of all orders: the second updates, deletes and inserts some rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    v1 = o.where(k % 14 != 3).withColumn("o_orderstatus", F.when(k % 12 == 1, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return o, v1.unionByName(o.where(k % 10 == 9).withColumn("o_orderkey", k + 100000000))


@query(
    "except_distinct",
    f"WITH {VERSION_SQL} SELECT o_orderstatus, o_orderkey % 100 AS slot FROM v1 EXCEPT SELECT o_orderstatus, o_orderkey % 100 FROM v0",
)
def except_distinct(spark, sf):
    v0, v1 = order_versions(spark, sf)
    shape = ["o_orderstatus", "o_orderkey % 100 AS slot"]
    return v1.selectExpr(*shape).subtract(v0.selectExpr(*shape))


@query(
    "except_all",
    f"""WITH {VERSION_SQL}, a AS (SELECT o_orderstatus, o_orderkey % 100 AS slot FROM v1), b AS (SELECT o_orderstatus, o_orderkey % 100 AS slot FROM v0)
    SELECT *, 'added' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def except_all(spark, sf):
    v0, v1 = order_versions(spark, sf)
    shape = ["o_orderstatus", "o_orderkey % 100 AS slot"]
    return two_way_difference(v1.selectExpr(*shape), v0.selectExpr(*shape))


# ---- masks and tokens (as scalar functions) -----------------------------------------------


@query(
    "mask_partial",
    """WITH p AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS tax_id,
      'GR' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 20, '0') AS iban FROM customer)
    SELECT c_custkey, '*****' || right(tax_id, 4) AS tax_id_masked, left(iban, 2) || '****' || right(iban, 4) AS iban_masked,
      substr(tax_id, 6, 4) AS tail FROM p""",
)
def mask_partial(spark, sf):
    p = table(spark, sf, "customer").select(
        "c_custkey",
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("tax_id"),
        F.concat(F.lit("GR"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 20, "0")).alias("iban"),
    )
    return p.select(
        "c_custkey",
        masking.keep_last("tax_id").alias("tax_id_masked"),
        masking.keep_ends("iban").alias("iban_masked"),
        F.substring("tax_id", 6, 4).alias("tail"),
    )
