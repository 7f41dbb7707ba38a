"""Role-dependent views, row filters and access reports. User and role are arguments: a
library cannot trust what a session says about its caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles, column names taken as personal data, patterns of throw-away accounts.
FULL_ACCESS_ROLES = ("data_engineer", "admin")
AMOUNT_ROLES = ("data_engineer", "admin", "auditor")
DEFAULT_ROLE = "public"
PII_COLUMN_NAMES = ("afm", "amka", "email", "tax_amount_eur", "income", "phone", "iban")
STALE_PRINCIPAL_PATTERN = "(temp|intern|guest|test|former)"


def role_of(user_roles: DataFrame, user: str, user_col: str = "email", role_col: str = "role") -> str:
    """The user's role from the mapping table, ``public`` when the user is not in it. One
    value comes to the driver; the smallest role name is taken when there are several."""
    found = user_roles.where(F.col(user_col) == user).agg(F.min(role_col)).first()[0]
    return found if found is not None else DEFAULT_ROLE


def role_view(df: DataFrame, role: str, masks: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """``masks`` maps a column to (masked form, roles that see it in the clear)."""
    return df.withColumns({c: masked for c, (masked, clear) in masks.items() if role not in clear})


def entitled_rows(df: DataFrame, entitlements: DataFrame, user: str, column: str, user_col: str = "user_email", allowed_col: str = "allowed_region") -> DataFrame:
    """Rows whose value is in the user's list of the entitlement table."""
    mine = entitlements.where(F.col(user_col) == user).select(F.col(allowed_col).alias(column)).distinct()
    return df.join(mine, column, "left_semi")


def token_check(df: DataFrame, value: str, token: Column) -> DataFrame:
    """Distinct values and tokens; equal counts mean the pseudonym is one-to-one."""
    pairs = df.select(F.col(value).alias("v"), token.alias("t"))
    counts = pairs.agg(F.countDistinct("v").alias("distinct_values"), F.countDistinct("t").alias("distinct_tokens"))
    return counts.withColumn("one_to_one", F.col("distinct_values") == F.col("distinct_tokens"))


def pii_columns(tables: Mapping[str, DataFrame], names: Sequence[str] = PII_COLUMN_NAMES, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Columns that look like personal data, by name and optionally by value pattern. With
    ``patterns`` every string column is scanned whole, all of a table in one aggregate."""
    out = None
    for table, df in tables.items():
        columns = [(c, t) for c, t in df.dtypes if t == "string" or c.lower() in names]
        if not columns:
            continue
        checks = {k: p for k, p in (patterns or {}).items()}
        aggs = [F.count("*").alias("rows")] + [
            F.count_if(F.col(c).cast("string").rlike(p)).alias(f"h_{c}_{k}") for c, _ in columns for k, p in checks.items()
        ]
        structs = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.lit(c.lower() in names).alias("by_name"),
                *[F.col(f"h_{c}_{k}").alias(f"{k}_hits") for k in checks],
                F.col("rows").alias("rows"),
            )
            for c, t in columns
        ]
        found = df.agg(*aggs).select(F.inline(F.array(*structs)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no table has a candidate column")
    hit = F.col("by_name")
    for k in patterns or {}:
        hit = hit | (F.col(f"{k}_hits") > 0)
    return out.where(hit)


def coverage_gap(required: DataFrame, masked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every column that needs a mask, with its state."""
    have = masked.select(*keys).distinct().withColumn("__masked", F.lit(True))
    status = F.when(F.col("__masked"), F.lit("masked")).otherwise(F.lit("GAP"))
    return required.join(have, list(keys), "left").withColumn("status", status).drop("__masked")


def stale_grants(grants: DataFrame, today: Column, pattern: str = STALE_PRINCIPAL_PATTERN) -> DataFrame:
    """Grants to throw-away accounts and grants past their end date."""
    by_name = F.lower("principal").rlike(pattern)
    expired = F.coalesce(F.col("expires_on") < today, F.lit(False))
    reason = F.when(by_name & expired, "pattern+expired").when(by_name, "pattern").otherwise("expired")
    return grants.where(by_name | expired).withColumn("reason", reason)
