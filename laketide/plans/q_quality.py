"""Data quality: contracts, rules, quarantine, cleansing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions.scalars import ID_PATTERN, first_reason, money, nine_digit_id, normalize_category, parse_date
from laketide.operators import quality as dq
from laketide.operators.aggregates import unpivot_row
from laketide.operators.windows import latest_per_key
from laketide.plans.fixtures import SQL_D, SQL_I, STATUSES, VAT_RATES, as_of, declarations, invoices
from laketide.plans.q_basics import issue_columns
from laketide.plans.registry import query, table
from laketide.session import fresh_dir

ID_RE = "'^[0-9]{9}$'"

# ---- contract ---------------------------------------------------------------------------------

CONTRACT = {
    "columns": {
        "declaration_id": {"nullable": False},
        "tax_id": {"nullable": False, "pattern": ID_PATTERN},
        "amount": {"nullable": False, "min": 0.0, "max": 450000.0},
        "vat_amount": {"nullable": False, "severity": "warning"},
        "status": {"allowed": list(STATUSES)},
    }
}
# rule -> (SQL condition of a failing row, severity), in the order the contract compiles to
CONTRACT_SQL = {
    "declaration_id_null": ("declaration_id IS NULL", "error"),
    "tax_id_null": ("tax_id IS NULL", "error"),
    "tax_id_pattern": (f"tax_id IS NOT NULL AND NOT regexp_matches(tax_id, {ID_RE})", "error"),
    "amount_null": ("amount IS NULL", "error"),
    "amount_min": ("amount IS NOT NULL AND amount < 0", "error"),
    "amount_max": ("amount IS NOT NULL AND amount > 450000", "error"),
    "vat_amount_null": ("vat_amount IS NULL", "warning"),
    "status_allowed": ("status IS NOT NULL AND status NOT IN ('F', 'O', 'P')", "error"),
}
CONTRACT_BAD = " OR ".join(f"({c})" for c, severity in CONTRACT_SQL.values() if severity == "error")


def metrics_sql(rules: dict[str, tuple[str, str]], source: str = "d", action: str = "quarantine", unknown: bool = False) -> str:
    """One row per rule, in the shape of ``rule_metrics``."""
    rows = []
    for name, (bad, severity) in rules.items():
        failed = f"COUNT(CASE WHEN {bad} THEN 1 END)"
        missing = f"COUNT(CASE WHEN ({bad}) IS NULL THEN 1 END)"
        rows.append(
            f"""SELECT '{name}' AS rule, '{severity}' AS severity, '{action}' AS action, {failed} AS failed, {missing} AS unknown, COUNT(*) AS total,
            CAST({failed} AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS failure_pct, CAST(COUNT(*) - {failed} AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS pass_pct FROM {source}"""
        )
    return " UNION ALL ".join(rows)


@query("contract_report", f"WITH {SQL_D} {metrics_sql(CONTRACT_SQL)}")
def contract_report(spark, sf):
    return dq.rule_metrics(declarations(spark, sf), dq.contract_rules(CONTRACT))


@query(
    "contract_totals",
    f"""WITH {SQL_D} SELECT COUNT(*) AS total, COUNT(CASE WHEN NOT ({CONTRACT_BAD}) THEN 1 END) AS valid, COUNT(CASE WHEN {CONTRACT_BAD} THEN 1 END) AS invalid,
    CAST(COUNT(CASE WHEN {CONTRACT_BAD} THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS invalid_pct FROM d""",
)
def contract_totals(spark, sf):
    return dq.batch_metrics(declarations(spark, sf), dq.contract_rules(CONTRACT))


@query(
    "null_thresholds",
    f"""WITH {SQL_D} SELECT 'tax_id' AS "column", 5.0::DOUBLE AS max_pct, COUNT(*) - COUNT(tax_id) AS nulls, COUNT(*) AS total,
      CAST(COUNT(*) - COUNT(tax_id) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS null_pct, CAST(COUNT(*) - COUNT(tax_id) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) > 5.0 AS breached FROM d
    UNION ALL SELECT 'vat_amount', 1.0::DOUBLE, COUNT(*) - COUNT(vat_amount), COUNT(*),
      CAST(COUNT(*) - COUNT(vat_amount) AS DOUBLE) * 100.0::DOUBLE / COUNT(*), CAST(COUNT(*) - COUNT(vat_amount) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) > 1.0 FROM d""",
)
def null_thresholds(spark, sf):
    return dq.null_percentages(declarations(spark, sf), {"tax_id": 5.0, "vat_amount": 1.0})


@query(
    "contract_split",
    f"""WITH {SQL_D} SELECT declaration_id, {CONTRACT_BAD} AS is_invalid,
    {" || ".join(f"CASE WHEN {c} THEN '[{n}]' ELSE '' END" for n, (c, _) in CONTRACT_SQL.items())} AS failed_rules FROM d""",
)
def contract_split(spark, sf):
    """All failing rules of each row; the valid and the invalid part together are the table."""
    rules = dq.contract_rules(CONTRACT)
    valid, invalid = dq.split(dq.annotate(declarations(spark, sf), rules), rules)
    parts = [df.select("declaration_id", F.lit(flag).alias("is_invalid"), "failed_rules") for df, flag in ((valid, False), (invalid, True))]
    return parts[0].union(parts[1])


@query(
    "schema_drift",
    """SELECT 'region' AS "column", 'missing' AS drift, CAST(0 AS BIGINT) AS filled_rows UNION ALL SELECT 'afm', 'missing', 0
    UNION ALL SELECT 'o_custkey', 'extra', COUNT(o_custkey) FROM orders UNION ALL SELECT 'o_totalprice', 'extra', COUNT(o_totalprice) FROM orders""",
)
def schema_drift(spark, sf):
    expected = ["o_orderkey", "afm", "o_orderstatus", "o_orderdate", "o_orderpriority", "region"]
    return dq.schema_drift(table(spark, sf, "orders"), expected)


# ---- rules written as SQL -------------------------------------------------------------------------

# Column names of a declared contract that Spark SQL cannot read unquoted.
GREEK = {"declaration_id": "ΔηλωσηID", "amount": "Ποσό_EUR", "vat_amount": "ΦΠΑ", "status": "Κατάσταση", "tax_id": "ΑΦΜ"}
DECLARED = [
    {"id": "R1", "expression": "ΑΦΜ IS NOT NULL AND length(ΑΦΜ) = 9", "severity": "error", "action_on_fail": "quarantine"},
    {"id": "R2", "expression": "Ποσό_EUR >= 0", "severity": "error", "action_on_fail": "quarantine"},
    {"id": "R3", "expression": "Κατάσταση IN ('F', 'O', 'P')", "severity": "error", "action_on_fail": "quarantine"},
    {"id": "R4", "expression": "ΦΠΑ <= Ποσό_EUR * 0.2", "severity": "warning", "action_on_fail": "quarantine"},
]
DECLARED_SQL = {
    "R1": ("NOT (tax_id IS NOT NULL AND length(tax_id) = 9)", "error"),
    "R2": ("NOT (amount >= 0)", "error"),
    "R3": ("NOT (status IN ('F', 'O', 'P'))", "error"),
    "R4": ("NOT (vat_amount <= amount * 0.2::DOUBLE)", "warning"),
}
DECLARED_BAD = " OR ".join(f"({c})" for c, severity in DECLARED_SQL.values() if severity == "error")


def greek(spark, sf):
    return declarations(spark, sf).select(*GREEK).withColumnsRenamed(GREEK)


@query("rules_from_sql", f"WITH {SQL_D} {metrics_sql(DECLARED_SQL)}")
def rules_from_sql(spark, sf):
    df = greek(spark, sf)
    return dq.rule_metrics(df, dq.sql_rules(DECLARED, df.columns))


@query(
    "rules_split",
    f"""WITH {SQL_D} SELECT CASE WHEN {DECLARED_BAD} THEN 'invalid' ELSE 'valid' END AS side, COUNT(*) AS rows,
    COUNT(CASE WHEN {DECLARED_SQL['R4'][0]} THEN 1 END) AS warned FROM d GROUP BY 1""",
)
def rules_split(spark, sf):
    df = greek(spark, sf)
    rules = dq.sql_rules(DECLARED, df.columns)
    warned = F.count_if(rules[3].fails).alias("warned")
    out = None
    for side, part in zip(("valid", "invalid"), dq.split(df, rules)):
        one = part.agg(F.count("*").alias("rows"), warned).select(F.lit(side).alias("side"), "rows", "warned")
        out = one if out is None else out.union(one)
    return out


@query(
    "null_policy",
    f"""WITH {SQL_D}, m AS (SELECT vat_amount / amount > 0.2::DOUBLE AS bad FROM d)
    SELECT 'drop' AS policy, COUNT(CASE WHEN NOT bad THEN 1 END) AS valid, COUNT(CASE WHEN bad THEN 1 END) AS invalid FROM m
    UNION ALL SELECT 'fail', COUNT(CASE WHEN NOT bad THEN 1 END), COUNT(CASE WHEN bad OR bad IS NULL THEN 1 END) FROM m
    UNION ALL SELECT 'pass', COUNT(CASE WHEN NOT bad OR bad IS NULL THEN 1 END), COUNT(CASE WHEN bad THEN 1 END) FROM m""",
)
def null_policy(spark, sf):
    """A check that is NULL for some rows, under the three policies, in one aggregate."""
    rule = dq.Rule("vat_share", F.try_divide("vat_amount", "amount") > 0.2)
    policies = ("drop", "fail", "pass")
    masks = {p: dq.bad_mask([rule], p) for p in policies}
    counts = declarations(spark, sf).agg(
        *[F.count_if(~m).alias(f"{p}_valid") for p, m in masks.items()], *[F.count_if(m).alias(f"{p}_invalid") for p, m in masks.items()]
    )
    return unpivot_row(counts, [({"policy": p}, {"valid": f"{p}_valid", "invalid": f"{p}_invalid"}) for p in policies])


REASON_SQL = f"""CASE WHEN tax_id IS NULL THEN 'NULL_ID' WHEN length(tax_id) <> 9 THEN 'INVALID_ID_FORMAT' WHEN amount < 0 THEN 'NEGATIVE_AMOUNT'
    WHEN status NOT IN ('F', 'O', 'P') THEN 'INVALID_STATUS' END"""


def reasons():
    return first_reason(
        {
            "NULL_ID": F.col("tax_id").isNull(),
            "INVALID_ID_FORMAT": F.length("tax_id") != 9,
            "NEGATIVE_AMOUNT": F.col("amount") < 0,
            "INVALID_STATUS": ~F.col("status").isin(*STATUSES),
        }
    )


@query("quarantine_reason", f"WITH {SQL_D} SELECT declaration_id, {REASON_SQL} AS _reason FROM d WHERE {REASON_SQL} IS NOT NULL")
def quarantine_reason(spark, sf):
    flagged = declarations(spark, sf).withColumn("_reason", reasons())
    return flagged.where(F.col("_reason").isNotNull()).select("declaration_id", "_reason")


@query(
    "quarantine_write",
    f"""WITH {SQL_D} SELECT {REASON_SQL} AS _reason, 'run-1' AS _run_id, COUNT(*) AS rows FROM d WHERE {REASON_SQL} IS NOT NULL GROUP BY 1""",
)
def quarantine_write(spark, sf):
    path = fresh_dir(spark, "quarantine")
    bad = declarations(spark, sf).where(reasons().isNotNull())
    dq.quarantined(bad, "run-1", reasons(), as_of()).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("_reason", "_run_id").agg(F.count("*").alias("rows"))


@query(
    "publish_gate",
    f"""WITH {SQL_D}, m AS (SELECT COUNT(*) AS total, COUNT(CASE WHEN NOT ({CONTRACT_BAD}) THEN 1 END) AS valid, COUNT(CASE WHEN {CONTRACT_BAD} THEN 1 END) AS invalid FROM d)
    SELECT total, valid, invalid, CAST(invalid AS DOUBLE) * 100.0::DOUBLE / total AS invalid_pct,
      CAST(invalid AS DOUBLE) * 100.0::DOUBLE / total <= 50 AS published, CAST(invalid AS DOUBLE) * 100.0::DOUBLE / total <= 1 AS published_strict FROM m""",
)
def publish_gate(spark, sf):
    """The same batch at a loose and at a strict limit."""
    metrics = dq.batch_metrics(declarations(spark, sf), dq.contract_rules(CONTRACT))
    seen = metrics.first().asDict()

    def passes(limit):
        try:
            dq.gate(seen, limit)
            return True
        except dq.BatchRejected:
            return False

    return metrics.withColumn("published", F.lit(passes(50.0))).withColumn("published_strict", F.lit(passes(1.0)))


@query("rule_audit", f"WITH {SQL_D}, m AS ({metrics_sql(CONTRACT_SQL)}) SELECT *, 'run-1' AS run_id, TIMESTAMP '2024-01-31 00:00:00' AS checked_at FROM m")
def rule_audit(spark, sf):
    path = fresh_dir(spark, "rule_audit")
    rows = dq.rule_metrics(declarations(spark, sf), dq.contract_rules(CONTRACT))
    rows.withColumns({"run_id": F.lit("run-1"), "checked_at": as_of()}).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


# ---- reports, cleansing, expectations --------------------------------------------------------------

ISO_RE = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"


@query(
    "issue_report",
    f"""WITH {SQL_D}, known AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS tax_id FROM customer)
    SELECT 'null_id' AS issue, COUNT(CASE WHEN tax_id IS NULL THEN 1 END) AS rows FROM d
    UNION ALL SELECT 'bad_id', COUNT(CASE WHEN NOT regexp_matches(tax_id, {ID_RE}) THEN 1 END) FROM d
    UNION ALL SELECT 'negative_amount', COUNT(CASE WHEN amount < 0 THEN 1 END) FROM d
    UNION ALL SELECT 'future_date', COUNT(CASE WHEN try_strptime(filed_on, '%Y-%m-%d') > TIMESTAMP '2001-01-01' THEN 1 END) FROM d
    UNION ALL SELECT 'invalid_status', COUNT(CASE WHEN status NOT IN ('F', 'O', 'P') THEN 1 END) FROM d
    UNION ALL SELECT 'untrimmed_name', COUNT(CASE WHEN name <> trim(name) THEN 1 END) FROM d
    UNION ALL SELECT 'bad_date_format', COUNT(CASE WHEN NOT regexp_matches(filed_on, {ISO_RE}) THEN 1 END) FROM d
    UNION ALL SELECT 'null_vat', COUNT(CASE WHEN vat_amount IS NULL THEN 1 END) FROM d
    UNION ALL SELECT 'duplicate_key', COUNT(*) FROM (SELECT tax_id, filed_on FROM d WHERE tax_id IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1)
    UNION ALL SELECT 'orphan', COUNT(*) FROM d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.tax_id = d.tax_id)""",
)
def issue_report(spark, sf):
    """Eight row checks in one pass; duplicates and orphans need a shuffle of their own."""
    d = declarations(spark, sf)
    flags = issue_columns()
    checks = {
        "null_id": flags["has_null_id"],
        "bad_id": flags["has_bad_id"],
        "negative_amount": flags["has_negative_amount"],
        "future_date": F.try_to_date("filed_on", "yyyy-MM-dd") > F.lit("2001-01-01").cast("date"),
        "invalid_status": flags["has_invalid_status"],
        "untrimmed_name": F.col("name") != F.trim("name"),
        "bad_date_format": flags["has_bad_date"],
        "null_vat": F.col("vat_amount").isNull(),
    }
    one = d.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    rows = unpivot_row(one, [({"issue": n}, {"rows": n}) for n in checks])
    copies = d.where(F.col("tax_id").isNotNull()).groupBy("tax_id", "filed_on").count().where("count > 1")
    known = table(spark, sf, "customer").select(nine_digit_id("c_custkey").alias("tax_id"))
    orphan = d.select("tax_id").join(known, "tax_id", "left_anti")
    for name, df in (("duplicate_key", copies), ("orphan", orphan)):
        rows = rows.union(df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("issue"), "rows"))
    return rows


CLEAN_SQL = f"""{SQL_D}, clean AS (
  SELECT declaration_id, CASE WHEN regexp_matches(tax_id, {ID_RE}) THEN tax_id END AS tax_id, trim(name) AS name, category, amount, vat_group,
    CAST(CASE WHEN vat_amount IS NULL THEN CAST(amount AS DECIMAL(18,2)) * CAST(CASE vat_group WHEN 'VAT24' THEN 0.24 WHEN 'VAT13' THEN 0.13 WHEN 'VAT06' THEN 0.06 ELSE 0.00 END AS DECIMAL(4,2))
      ELSE CAST(vat_amount AS DECIMAL(20,4)) END AS DOUBLE) AS vat_amount,
    CASE WHEN status IN ('F', 'O', 'P') THEN status ELSE 'UNKNOWN' END AS status,
    CAST(COALESCE(try_strptime(filed_on, '%Y-%m-%d'), try_strptime(filed_on, '%Y/%m/%d')) AS DATE) AS filed_on, cust
  FROM d WHERE tax_id IS NOT NULL AND amount >= 0)"""


def clean_declarations(spark, sf):
    """Filter, trim, unify dates, normalize the status, rebuild a missing tax from its rate."""
    rate = F.lit(None).cast("decimal(4,2)")
    for group, value in VAT_RATES.items():
        rate = F.when(F.col("vat_group") == group, F.lit(value).cast("decimal(4,2)")).otherwise(rate)
    return (
        declarations(spark, sf)
        .where(F.col("tax_id").isNotNull() & (F.col("amount") >= 0))
        .withColumns(
            {
                "filed_on": parse_date("filed_on"),
                "name": F.trim("name"),
                "tax_id": F.when(F.col("tax_id").rlike(ID_PATTERN), F.col("tax_id")),
                "status": normalize_category("status", STATUSES),
                "vat_amount": F.coalesce(F.col("vat_amount"), (money("amount") * rate).cast("double")),
            }
        )
        .drop("filed_at")
    )


@query(
    "cleanse_orders",
    f"""WITH {CLEAN_SQL} SELECT * EXCLUDE (rn), CAST(CAST(amount AS DECIMAL(18,2)) + CAST(vat_amount AS DECIMAL(20,4)) AS DOUBLE) AS total_amount
    FROM (SELECT *, row_number() OVER (PARTITION BY cust, filed_on ORDER BY amount DESC, declaration_id DESC) AS rn FROM clean) WHERE rn = 1""",
)
def cleanse_orders(spark, sf):
    """Cleansed rows, the largest declaration per customer and day."""
    kept = latest_per_key(clean_declarations(spark, sf), ["cust", "filed_on"], ["amount", "declaration_id"])
    both = money("amount") + F.col("vat_amount").cast("decimal(20,4)")
    return kept.withColumn("total_amount", both.cast("double"))


@query(
    "expectations",
    f"""WITH {SQL_D} SELECT declaration_id, CASE WHEN vat_amount IS NULL THEN '[vat_present]' ELSE '' END || CASE WHEN name <> trim(name) THEN '[name_trimmed]' ELSE '' END AS warnings
    FROM d WHERE tax_id IS NOT NULL AND amount >= 0""",
)
def expectations(spark, sf):
    return dq.expectations(
        declarations(spark, sf),
        warn=[dq.Rule("vat_present", F.col("vat_amount").isNull()), dq.Rule("name_trimmed", F.col("name") != F.trim("name"))],
        drop=[dq.Rule("id_present", F.col("tax_id").isNull()), dq.Rule("amount_positive", F.col("amount") < 0)],
        fail=[dq.Rule("key_present", F.col("declaration_id").isNull())],
    ).select("declaration_id", "warnings")


@query(
    "business_rule",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount FROM lineitem
    WHERE NOT (abs(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) + CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) - CAST(l_extendedprice AS DECIMAL(18,2))) <= 0.01
      AND l_quantity * 2000 >= l_extendedprice)""",
)
def business_rule(spark, sf):
    """Net plus discount must give the gross amount, and the gross must fit the quantity."""
    gross, rate = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
    balanced = F.abs(gross * (1 - rate) + gross * rate - gross) <= 0.01
    fits = F.col("l_quantity") * 2000 >= F.col("l_extendedprice")
    rows = table(spark, sf, "lineitem").where(~(balanced & fits))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount")


# The columns, rule types and actions of a rule table.
RULE_ROWS = [
    {"rule_id": "DQ001", "rule_type": "completeness", "rule_expression": "invoice_id IS NOT NULL", "action_on_fail": "quarantine", "severity": "error"},
    {"rule_id": "DQ002", "rule_type": "range", "rule_expression": "net >= 1000", "action_on_fail": "quarantine", "severity": "error"},
    {"rule_id": "DQ003", "rule_type": "uniqueness", "rule_expression": "invoice_id UNIQUE", "action_on_fail": "deduplicate", "severity": "warn"},
    {"rule_id": "DQ004", "rule_type": "business_rule", "rule_expression": "vat <= net * 0.07", "action_on_fail": "reject_batch", "severity": "error"},
    {"rule_id": "DQ006", "rule_type": "referential_integrity", "rule_expression": "issuer EXISTS IN suppliers", "action_on_fail": "alert", "severity": "error"},
]
RULE_ROWS_SQL = f"""{SQL_I}, dup AS (SELECT invoice_id FROM i GROUP BY 1 HAVING COUNT(*) > 1), known AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"""


@query(
    "rule_table_eval",
    f"""WITH {RULE_ROWS_SQL}, n AS (SELECT COUNT(*) AS total FROM i), f AS (
      SELECT 'DQ001' AS rule, 'error' AS severity, 'quarantine' AS action, (SELECT COUNT(*) FROM i WHERE invoice_id IS NULL) AS failed
      UNION ALL SELECT 'DQ002', 'error', 'quarantine', (SELECT COUNT(*) FROM i WHERE NOT (net >= 1000))
      UNION ALL SELECT 'DQ003', 'warn', 'deduplicate', (SELECT COUNT(*) FROM i WHERE invoice_id IN (SELECT invoice_id FROM dup))
      UNION ALL SELECT 'DQ004', 'error', 'reject_batch', (SELECT COUNT(*) FROM i WHERE NOT (vat <= net * 0.07::DOUBLE))
      UNION ALL SELECT 'DQ006', 'error', 'alert', (SELECT COUNT(*) FROM i WHERE issuer NOT IN (SELECT s_suppkey FROM known)))
    SELECT rule, severity, action, failed, CAST(0 AS BIGINT) AS unknown, total, CAST(failed AS DOUBLE) * 100.0::DOUBLE / total AS failure_pct,
      CAST(total - failed AS DOUBLE) * 100.0::DOUBLE / total AS pass_pct, failed > 0 AS fired,
      (SELECT COUNT(DISTINCT invoice_id) FROM i WHERE net >= 1000) AS clean_rows, (SELECT COUNT(*) FROM i WHERE NOT (net >= 1000)) AS quarantined_rows FROM f, n""",
)
def rule_table_eval(spark, sf):
    """Rules read as table rows, each with its action; an issuer must be a supplier without debts."""
    known = table(spark, sf, "supplier").where("s_acctbal >= 0")
    raw = invoices(spark, sf)
    flagged, rules = dq.rule_table_rules(raw, RULE_ROWS, {"suppliers": (known, "s_suppkey")})
    good, bad, outcome = dq.apply_rule_actions(raw, flagged, rules, ["invoice_id"], ["issued_at"])
    clean_rows, quarantined_rows = good.count(), bad.count()
    return outcome.withColumns({"clean_rows": F.lit(clean_rows).cast("bigint"), "quarantined_rows": F.lit(quarantined_rows).cast("bigint")})


@query(
    "dq_metrics",
    f"""WITH {SQL_D}, {SQL_I} SELECT 'declarations' AS source, rule, failed, total, failure_pct FROM ({metrics_sql({"id_present": ("tax_id IS NULL", "error"), "amount_positive": ("amount < 0", "error")})})
    UNION ALL SELECT 'invoices', rule, failed, total, failure_pct FROM ({metrics_sql({"net_floor": ("net < 2000", "error"), "not_cancelled": ("status = 'Cancelled'", "error")}, "i")})""",
)
def dq_metrics(spark, sf):
    sources = {
        "declarations": (declarations(spark, sf), [dq.Rule("id_present", F.col("tax_id").isNull()), dq.Rule("amount_positive", F.col("amount") < 0)]),
        "invoices": (invoices(spark, sf), [dq.Rule("net_floor", F.col("net") < 2000), dq.Rule("not_cancelled", F.col("status") == "Cancelled")]),
    }
    out = None
    for name, (df, rules) in sources.items():
        rows = dq.rule_metrics(df, rules).select(F.lit(name).alias("source"), "rule", "failed", "total", "failure_pct")
        out = rows if out is None else out.union(rows)
    return out
