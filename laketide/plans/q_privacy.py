"""Masking, tokens, role views, row filters and access reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions import masking
from laketide.functions.scalars import nine_digit_id
from laketide.operators import privacy
from laketide.plans.registry import query, table

PEOPLE_SQL = """p AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS afm, 'Name' || CAST(c_custkey % 97 AS VARCHAR) || ' Last' || CAST(c_custkey % 89 AS VARCHAR) AS full_name,
    'c' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email, (c_acctbal + 1000) * 10 AS annual_income, r_name AS region, c_mktsegment AS sector
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def people(spark, sf):
    """Contact fields built from the customer table."""
    k = F.col("c_custkey")
    placed = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return placed.select(
        "c_custkey",
        nine_digit_id(k).alias("afm"),
        F.concat(F.lit("Name"), (k % 97).cast("string"), F.lit(" Last"), (k % 89).cast("string")).alias("full_name"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example")).alias("email"),
        ((F.col("c_acctbal") + 1000) * 10).alias("annual_income"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("sector"),
    )


@query("mask_email", f"WITH {PEOPLE_SQL} SELECT c_custkey, left(email, 1) || '***@' || split_part(email, '@', 2) AS email FROM p")
def mask_email(spark, sf):
    return people(spark, sf).select("c_custkey", masking.email("email").alias("email"))


@query("mask_name", f"WITH {PEOPLE_SQL} SELECT c_custkey, left(split_part(full_name, ' ', 1), 1) || '. ' || split_part(full_name, ' ', 2) AS name_masked FROM p")
def mask_name(spark, sf):
    return people(spark, sf).select("c_custkey", masking.initial_and_last_name("full_name").alias("name_masked"))


BAND_SQL = "CASE WHEN annual_income IS NULL THEN NULL WHEN annual_income < 30000 THEN '< 30k' WHEN annual_income < 70000 THEN '30k–70k' ELSE '70k+' END"


@query("mask_band", f"WITH {PEOPLE_SQL} SELECT c_custkey, {BAND_SQL} AS income_band FROM p")
def mask_band(spark, sf):
    return people(spark, sf).select("c_custkey", masking.income_band("annual_income").alias("income_band"))


@query(
    "mask_from_contract",
    f"WITH {PEOPLE_SQL} SELECT c_custkey, '*****' || right(afm, 4) AS afm, left(full_name, 1) || '***' AS full_name, region FROM p",
)
def mask_from_contract(spark, sf):
    contract = {"masking": {"afm": "show_last_4", "full_name": "first_letter_only"}}
    rows = people(spark, sf).select("c_custkey", "afm", "full_name", "region")
    return masking.mask_by_contract(rows, contract["masking"])


@query(
    "tokenize_sha2",
    f"WITH {PEOPLE_SQL} SELECT c_custkey, sha256(afm) AS token, sha256(afm || 'pepper') AS salted_token FROM p",
)
def tokenize_sha2(spark, sf):
    return people(spark, sf).select(
        "c_custkey", masking.token("afm").alias("token"), masking.token("afm", "pepper").alias("salted_token")
    )


@query(
    "token_one_to_one",
    "SELECT COUNT(DISTINCT o_custkey) AS distinct_values, COUNT(DISTINCT sha256(lpad(CAST(o_custkey AS VARCHAR), 9, '0') || 'pepper')) AS distinct_tokens, true AS one_to_one FROM orders",
)
def token_one_to_one(spark, sf):
    rows = table(spark, sf, "orders").select(nine_digit_id("o_custkey").alias("afm"))
    return privacy.token_check(rows, "afm", masking.token("afm", "pepper"))


@query("sql_udf_mask", f"WITH {PEOPLE_SQL} SELECT c_custkey, CASE WHEN length(afm) >= 4 THEN '*****' || right(afm, 4) END AS afm_masked FROM p")
def sql_udf_mask(spark, sf):
    """The mask as a SQL function; Spark inlines its body into the plan."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION lt_mask_id(v STRING) RETURNS STRING
        RETURN CASE WHEN length(v) >= 4 THEN concat('*****', right(v, 4)) END"""
    )
    people(spark, sf).createOrReplaceTempView("lt_people")
    return spark.sql("SELECT c_custkey, lt_mask_id(afm) AS afm_masked FROM lt_people")


def staff(spark, sf):
    """User to role mapping from the supplier table."""
    s = F.col("s_suppkey")
    role = F.when(s % 4 == 0, "analyst").when(s % 4 == 1, "auditor").when(s % 4 == 2, "data_engineer").otherwise("admin")
    return table(spark, sf, "supplier").select(F.concat(F.lit("user"), s.cast("string"), F.lit("@corp.example")).alias("email"), role.alias("role"))


@query(
    "role_masked_view",
    f"""WITH {PEOPLE_SQL} SELECT 'analyst' AS viewer, c_custkey, '*****' || right(afm, 4) AS afm, 'hidden' AS annual_income FROM p
    UNION ALL SELECT 'data_engineer', c_custkey, afm, CAST(CAST(annual_income AS DECIMAL(18,2)) AS VARCHAR) FROM p
    UNION ALL SELECT 'public', c_custkey, '*****' || right(afm, 4), 'hidden' FROM p""",
)
def role_masked_view(spark, sf):
    """One view, three callers: two in the mapping table, one unknown."""
    exact = people(spark, sf).select("c_custkey", "afm", F.col("annual_income").cast("decimal(18,2)").cast("string").alias("annual_income"))
    masks = {
        "afm": (masking.keep_last("afm"), privacy.FULL_ACCESS_ROLES),
        "annual_income": (F.lit("hidden"), privacy.AMOUNT_ROLES),
    }
    roles, out = staff(spark, sf), None
    for user in ("user0@corp.example", "user2@corp.example", "nobody@corp.example"):
        role = privacy.role_of(roles, user)
        view = privacy.role_view(exact, role, masks).select(F.lit(role).alias("viewer"), "c_custkey", "afm", "annual_income")
        out = view if out is None else out.union(view)
    return out


@query(
    "row_filter_entitlement",
    f"""WITH {PEOPLE_SQL}, e AS (SELECT 'user' || CAST(n_nationkey AS VARCHAR) AS user_email, r_name AS allowed_region FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'user' || CAST(n_nationkey + 1 AS VARCHAR), r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, region FROM p WHERE region IN (SELECT allowed_region FROM e WHERE user_email = 'user3')""",
)
def row_filter_entitlement(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def grants(shift):
        user = F.concat(F.lit("user"), (F.col("n_nationkey") + shift).cast("string"))
        return places.select(user.alias("user_email"), F.col("r_name").alias("allowed_region"))

    return privacy.entitled_rows(people(spark, sf), grants(0).union(grants(1)), "user3", "region").select("c_custkey", "region")


@query(
    "pii_discovery",
    f"""WITH {PEOPLE_SQL} SELECT 'people' AS table_name, 'afm' AS column_name, 'string' AS data_type, true AS by_name, CAST(0 AS BIGINT) AS email_hits, COUNT(*) AS nine_digit_hits, COUNT(*) AS rows FROM p
    UNION ALL SELECT 'people', 'email', 'string', true, COUNT(*), CAST(0 AS BIGINT), COUNT(*) FROM p
    UNION ALL SELECT 'documents', 'text', 'string', false, COUNT(CASE WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+') THEN 1 END), COUNT(CASE WHEN regexp_matches(text, '^[0-9]{{9}}$') THEN 1 END), COUNT(*) FROM documents""",
)
def pii_discovery(spark, sf):
    """Columns found by their name, and by scanning all values, whole texts included."""
    patterns = {"email": "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+", "nine_digit": "^[0-9]{9}$"}
    return privacy.pii_columns({"people": people(spark, sf), "documents": table(spark, sf, "documents")}, patterns=patterns)


GRANTS_SQL = """g AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'temp_' WHEN 1 THEN 'intern_' ELSE 'staff_' END || CAST(c_custkey AS VARCHAR) AS principal,
    CASE WHEN c_custkey % 3 = 0 THEN 'SELECT' ELSE 'MODIFY' END AS privilege, n_name AS object_name,
    CASE WHEN c_custkey % 4 <> 3 THEN DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) END AS expires_on FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def grants_log(spark, sf):
    """A grants table from the customer table, one row per customer."""
    k = F.col("c_custkey")
    who = F.when(k % 5 == 0, "temp_").when(k % 5 == 1, "intern_").otherwise("staff_")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat(who, k.cast("string")).alias("principal"),
        F.when(k % 3 == 0, "SELECT").otherwise("MODIFY").alias("privilege"),
        F.col("n_name").alias("object_name"),
        F.when(k % 4 != 3, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))).alias("expires_on"),
    )


@query(
    "stale_grants",
    f"""WITH {GRANTS_SQL}, m AS (SELECT *, regexp_matches(lower(principal), '(temp|intern|guest|test|former)') AS by_name, COALESCE(expires_on < DATE '2024-01-31', false) AS expired FROM g)
    SELECT principal, privilege, object_name, expires_on, CASE WHEN by_name AND expired THEN 'pattern+expired' WHEN by_name THEN 'pattern' ELSE 'expired' END AS reason FROM m WHERE by_name OR expired""",
)
def stale_grants(spark, sf):
    return privacy.stale_grants(grants_log(spark, sf), F.lit("2024-01-31").cast("date"))


@query("grant_summary", f"WITH {GRANTS_SQL} SELECT split_part(principal, '_', 1) AS kind, privilege, COUNT(*) AS grants, COUNT(DISTINCT object_name) AS objects FROM g GROUP BY 1, 2")
def grant_summary(spark, sf):
    kind = F.split_part(F.col("principal"), F.lit("_"), F.lit(1)).alias("kind")
    return grants_log(spark, sf).groupBy(kind, "privilege").agg(F.count("*").alias("grants"), F.countDistinct("object_name").alias("objects"))


@query(
    "coverage_gap",
    f"""WITH {GRANTS_SQL}, req AS (SELECT DISTINCT object_name, principal FROM g WHERE privilege = 'SELECT'), m AS (SELECT DISTINCT object_name, principal FROM g WHERE expires_on >= DATE '2024-01-31')
    SELECT object_name, principal, CASE WHEN m.principal IS NOT NULL THEN 'masked' ELSE 'GAP' END AS status FROM req LEFT JOIN m USING (object_name, principal)""",
)
def coverage_gap(spark, sf):
    """What must be covered against what is; here grants that need a live protection entry."""
    g = grants_log(spark, sf)
    required = g.where("privilege = 'SELECT'").select("object_name", "principal").distinct()
    masked = g.where(F.col("expires_on") >= F.lit("2024-01-31").cast("date"))
    return privacy.coverage_gap(required, masked, ["object_name", "principal"])
