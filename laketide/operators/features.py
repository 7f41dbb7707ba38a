"""Feature building, leakage checks and data splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import percent
from laketide.operators.aggregates import exact_quantiles, unpivot_row

# Correlation limits of the target-leakage check.
LEAKAGE_LIMIT = 0.95
SUSPICION_LIMIT = 0.5


def median_impute(df: DataFrame, columns: Sequence[str], exact: bool = False, error: float = 0.01) -> DataFrame:
    """Fill NULLs with the column median. The approximate medians of all columns come from
    one aggregate; ``exact`` uses the two-level count instead. One value per column is
    carried by the driver."""
    if exact:
        medians = {c: exact_quantiles(df, c, [0.5]).first()["q0"] for c in columns}
    else:
        accuracy = max(1, round(1 / error))
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns]).first()
        medians = row.asDict()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")) for c in columns})


def feature_correlations(df: DataFrame, features: Sequence[str], target: str, decimals: int = 6) -> DataFrame:
    """Correlation of every feature with the target, all in one aggregate. A feature without
    variance gets NULL. Pairs with a NULL are left out, feature by feature."""
    aggs = []
    y = F.col(target).cast("double")
    for f in features:
        x = F.col(f).cast("double")
        both = x.isNotNull() & y.isNotNull()
        # corr() itself raises under ANSI mode when a side has no variance. Merged partial
        # averages are not exact, so "no variance" is decided by the range, not by stddev = 0.
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        aggs += [
            F.try_divide(F.covar_pop(x, y), spread).alias(f"c_{f}"),
            F.count_if(both).alias(f"n_{f}"),
            ((F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))).alias(f"ok_{f}"),
        ]
    rows = unpivot_row(
        df.agg(*aggs),
        [({"feature": f}, {"n": f"n_{f}", "raw": f"c_{f}", "varies": f"ok_{f}"}) for f in features],
    )
    value = F.when(F.col("varies"), F.round("raw", decimals))
    return rows.select("feature", "n", value.alias("correlation"), F.abs(value).alias("abs_correlation"))


def leakage_tiers(correlations: DataFrame) -> DataFrame:
    a = F.col("abs_correlation")
    tier = (
        F.when(a.isNull(), "undefined")
        .when(a > LEAKAGE_LIMIT, "leakage")
        .when(a > SUSPICION_LIMIT, "suspicious")
        .otherwise("ok")
    )
    return correlations.withColumn("tier", tier)


def temporal_leakage(df: DataFrame, event_time: str, candidates: Sequence[str]) -> DataFrame:
    """Per candidate column, the share of rows whose time lies after the event; one pass."""
    aggs = []
    for c in candidates:
        both = F.col(c).isNotNull() & F.col(event_time).isNotNull()
        aggs += [F.count_if(both).alias(f"n_{c}"), F.count_if(both & (F.col(c) > F.col(event_time))).alias(f"f_{c}")]
    rows = unpivot_row(
        df.agg(*aggs), [({"feature": c}, {"rows_checked": f"n_{c}", "rows_in_future": f"f_{c}"}) for c in candidates]
    )
    return rows.withColumn("pct_in_future", percent(F.col("rows_in_future"), F.col("rows_checked")))


def temporal_split(df: DataFrame, at: str, cutoff: Column, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Train before the cutoff, test from it on; leaking columns are dropped."""
    kept = df.drop(*drop)
    return kept.where(F.col(at) < cutoff), kept.where(F.col(at) >= cutoff)


def stratified_split(df: DataFrame, key: str, label: str, train_pct: int = 80) -> DataFrame:
    """Add ``split``. The hash of (label, key) is uniform within each class, so every class is
    divided alike and a row always lands on the same side. SHA-256 of ``label|key`` as text, so
    other systems find the same split; NULLs count as empty text."""
    text = F.concat_ws("|", F.coalesce(F.col(label).cast("string"), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("")))
    bucket = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(bucket < train_pct, "train").otherwise("test"))


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """0/1 column per known category; the categories are part of the trained model."""
    name = prefix or column
    return df.withColumns({f"{name}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def outcome_rates(df: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(success).alias("passed"))
    return counts.withColumn("pass_rate", percent(F.col("passed"), F.col("total")))


def risk_score(points: Sequence[tuple[Column, int]]) -> Column:
    """Sum of points over the conditions that hold."""
    score = F.lit(0)
    for condition, value in points:
        score = score + F.when(condition, F.lit(value)).otherwise(F.lit(0))
    return score


def tier(score: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose limit the score reaches; limits from high to low."""
    out = F.lit(otherwise)
    for limit, label in sorted(limits):
        out = F.when(score >= limit, F.lit(label)).otherwise(out)
    return out


def active_labels(flags: Mapping[str, Column]) -> Column:
    """Array of the labels whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in flags.items()]))
