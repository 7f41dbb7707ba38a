"""Drift between a reference and a current sample: PSI, KS, JS distance. All are counts by
bin or by value; no sample is gathered."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime
from functools import partial
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laketide.operators.windows import HOT_ROWS, prefix_sums, range_chunks
from laketide.sources.writers import stored

# Floor for empty bins, number of bins, severity limits.
EMPTY_BIN = 1e-6
BINS = 10
SEVERITY = ((0.1, "ok"), (0.2, "watch"))
WORST = "retrain"


def severity(psi: Column) -> Column:
    out = F.lit(WORST)
    for limit, label in reversed(SEVERITY):
        out = F.when(psi < limit, F.lit(label)).otherwise(out)
    return out


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the upper edge belongs to the last bin, NULL to none."""
    place = F.floor((x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * bins).cast("int")
    # greatest() and least() skip NULLs, so an unguarded NULL would count as bin 0
    return F.when(x.isNotNull(), F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))


def histograms(df: DataFrame, side: Column, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Counts per (feature, bin) of both sides. ``side`` is true for current rows, false for
    reference rows. Ranges are taken over both sides, in one aggregate for all features."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tagged = df.select(
        side.alias("is_current"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        equal_width_bin(F.col(c).cast("double"), F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]), bins).alias("bin"),
                    )
                    for c in features
                ]
            )
        ),
    ).where("bin is not null")
    return tagged.groupBy("feature", "bin").agg(
        F.count_if(F.col("is_current")).alias("cur"), F.count_if(~F.col("is_current")).alias("ref")
    )


def psi(counts: DataFrame, decimals: int = 6) -> DataFrame:
    """Population stability index per feature. A bin that is empty on both sides adds nothing
    (both shares take the floor), so only occupied bins are needed."""
    totals = counts.groupBy("feature").agg(F.sum("cur").alias("cur_n"), F.sum("ref").alias("ref_n"))
    shares = counts.join(totals, "feature")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(part) == 0, F.lit(EMPTY_BIN)).otherwise(F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)))

    c, r = share("cur", "cur_n"), share("ref", "ref_n")
    value = F.round(F.sum((c - r) * F.log(c / r)), decimals)
    return shares.groupBy("feature").agg(value.alias("psi")).withColumn("severity", severity(F.col("psi")))


def js_distance(counts: DataFrame, keys: Sequence[str], decimals: int = 6) -> DataFrame:
    """Jensen-Shannon distance (base 2) per key from columns ``cur`` and ``ref``."""
    totals = counts.groupBy(*keys).agg(F.sum("cur").alias("cur_n"), F.sum("ref").alias("ref_n"))
    shares = counts.join(totals, list(keys))
    c, r = F.col("cur").cast("double") / F.col("cur_n"), F.col("ref").cast("double") / F.col("ref_n")
    m = (c + r) / 2

    def term(p: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    divergence = F.sum((term(c) + term(r)) / 2)
    return shares.groupBy(*keys).agg(F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), decimals).alias("js_distance"))


def ks(
    df: DataFrame, side: Column, feature: str, decimals: int = 6, chunks: int = 256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value, one row.

    Rows are counted by value, then the counts are summed along the value order in two
    levels; no task sees all values.
    """
    x = df.select(F.col(feature).cast("double").alias("v"), side.cast("int").alias("c")).where("v is not null")
    counts = stored(x.groupBy("v").agg(F.sum("c").alias("cur"), F.sum(1 - F.col("c")).alias("ref")), "value_counts")
    chunk = partial(range_chunks, counts, "v", chunks)
    sizes = counts.agg(F.sum("cur").alias("m"), F.sum("ref").alias("n")).first()
    m, n = sizes["m"] or 0, sizes["n"] or 0
    if not m or not n:
        raise ValueError("both sides of a KS test need rows")
    running = prefix_sums(counts, [], ["v"], {"cum_cur": F.col("cur"), "cum_ref": F.col("ref")}, chunk, hot_rows=hot_rows)
    gap = F.abs(F.col("cum_cur") / F.lit(float(m)) - F.col("cum_ref") / F.lit(float(n)))
    result = running.agg(F.max(gap).alias("raw"))
    root = math.sqrt(m * n / (m + n))
    scaled = F.col("raw") * (root + 0.12 + 0.11 / root)

    def term(k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return sign * F.exp(-2.0 * k * k * scaled * scaled)

    series = 2.0 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda total, k: total + term(k))
    p = F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return result.select(
        F.lit(feature).alias("feature"), F.round("raw", decimals).alias("ks_statistic"), F.round(p, decimals).alias("ks_pvalue")
    )


def value_counts(df: DataFrame, side: Column, features: Sequence[str]) -> DataFrame:
    """``feature``, ``v``, ``cur``, ``ref``: how often each value stands on both sides, for all features in
    one scan of ``df``. Counted before the shuffle and stored; all drift measures read this table."""
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]))
    tagged = df.select(side.cast("int").alias("c"), values).where("v is not null")
    return stored(tagged.groupBy("feature", "v").agg(F.sum("c").alias("cur"), F.sum(1 - F.col("c")).alias("ref")), "value_counts")


def histograms_of(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """``histograms`` from stored value counts."""
    ends = counts.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row per feature
    placed = counts.join(F.broadcast(ends), "feature").select("feature", equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), "cur", "ref")
    return placed.groupBy("feature", "bin").agg(F.sum("cur").alias("cur"), F.sum("ref").alias("ref"))


def running_counts(counts: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """``counts`` with ``cum_cur`` and ``cum_ref``, summed along the values of each feature.

    In two levels: each feature is cut into value ranges of about ``chunk_rows`` distinct values at
    approximate quantiles of its own, ranges are summed alone, and one row per range is put in
    order per feature. The ranges change the balance, never a result."""
    sizes = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row per feature
    pieces = max([1, *[-(-n // chunk_rows) for n in sizes.values()]])
    if pieces == 1:
        chunk = F.lit(0)
        placed = counts.withColumn("chunk", chunk)
    else:
        at = [i / pieces for i in range(1, pieces)]
        bounds = counts.groupBy("feature").agg(F.percentile_approx("v", F.lit(at), F.lit(10 * pieces)).alias("bounds"))
        # the bounds that lie below a value, by the largest: an array of a feature is sorted
        below = F.size(F.filter("bounds", lambda b: b <= F.col("v")))
        placed = counts.join(F.broadcast(bounds), "feature").withColumn("chunk", below).drop("bounds")
    inside = Window.partitionBy("feature", "chunk").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("feature").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("feature", "chunk").agg(F.sum("cur").alias("c"), F.sum("ref").alias("r"))
    carry = carry.select("feature", "chunk", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in ("c", "r")])
    local = placed.withColumns({"in_cur": F.sum("cur").over(inside), "in_ref": F.sum("ref").over(inside)})
    joined = local.join(carry, ["feature", "chunk"])
    return joined.select(*counts.columns, (F.col("in_cur") + F.col("before_c")).alias("cum_cur"), (F.col("in_ref") + F.col("before_r")).alias("cum_ref"))


def ks_of(counts: DataFrame, decimals: int = 6, chunk_rows: int = 1_000_000) -> DataFrame:
    """The Kolmogorov-Smirnov statistic and its asymptotic p-value of all features, from stored value
    counts. A feature without rows on one side has none (NULL)."""
    sizes = counts.groupBy("feature").agg(F.sum("cur").alias("m"), F.sum("ref").alias("n"))
    gap = F.abs(F.try_divide(F.col("cum_cur").cast("double"), F.col("m")) - F.try_divide(F.col("cum_ref").cast("double"), F.col("n")))
    raw = running_counts(counts, chunk_rows).join(F.broadcast(sizes), "feature").groupBy("feature", "m", "n").agg(F.max(gap).alias("raw"))
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    root = F.sqrt(m * n / (m + n))
    scaled = F.when((F.col("m") > 0) & (F.col("n") > 0), F.col("raw") * (root + 0.12 + F.lit(0.11) / F.when(root > 0, root)))
    shown = raw.select("feature", "raw", scaled.alias("s"))

    def term(k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return sign * F.exp(-2.0 * k * k * F.col("s") * F.col("s"))

    series = 2.0 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda total, k: total + term(k))
    p = F.when(F.col("s") < 0.2, F.lit(1.0)).when(F.col("s").isNotNull(), F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return shown.select("feature", F.round("raw", decimals).alias("ks_statistic"), F.round(p, decimals).alias("ks_pvalue"))


def drift_report(df: DataFrame, side: Column, features: Sequence[str], psi_limit: float = 0.2, p_limit: float = 0.05) -> DataFrame:
    """PSI, KS and the drift flag per feature, from one scan of ``df``."""
    counts = value_counts(df, side, features)
    report = psi(histograms_of(counts)).join(ks_of(counts), "feature")
    return report.withColumn("drift_detected", F.coalesce((F.col("psi") > psi_limit) | (F.col("ks_pvalue") < p_limit), F.lit(False)))


class DriftHistory:
    """Drift reports of all runs, one folder a run: a run that is repeated replaces its own rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, report: DataFrame, run_id: str, model_version: str, checked_at: datetime) -> None:
        marked = report.withColumns({"run_id": F.lit(run_id), "model_version": F.lit(model_version), "checked_at": F.lit(checked_at).cast("timestamp_ntz")})
        marked.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={quote(run_id, safe='')}")

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path).drop("run")

    def since_drift(self) -> DataFrame:
        """Per feature the newest run, whether it drifts, and how many runs in a row up to it did."""
        runs = self.read()
        newest = runs.groupBy("feature").agg(
            F.max("checked_at").alias("checked_at"), F.max_by("drift_detected", "checked_at").alias("drift_detected"), F.max(F.when(~F.col("drift_detected"), F.col("checked_at"))).alias("__calm")
        )
        later = runs.join(newest.select("feature", "__calm"), "feature").where(F.col("drift_detected") & (F.col("__calm").isNull() | (F.col("checked_at") > F.col("__calm"))))
        return newest.drop("__calm").join(later.groupBy("feature").agg(F.count("*").alias("runs_in_drift")), "feature", "left").fillna(0, ["runs_in_drift"])
