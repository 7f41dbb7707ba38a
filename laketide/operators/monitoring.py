"""Monitoring reports over run logs. ``as_of`` replaces the current time, so a report can be
repeated for any moment.

Run log columns: ``job_id, run_id, started_at, finished_at, state, duration_s``;
jobs: ``job_id, name, owner, deleted_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import mean, percent
from laketide.operators import drift
from laketide.operators.windows import bounded_frame

# Run states, health limit, severity order, alert limits.
SUCCEEDED, FAILED, TIMED_OUT, CANCELED = "SUCCEEDED", "FAILED", "TIMEDOUT", "CANCELED"
FAILURE_STATES = ("FAILED", "TIMEDOUT", "ERROR")
DEGRADED_SHARE = 0.2
SEVERITY_ORDER = ("critical", "warning", "info")


def since(df: DataFrame, as_of: Column, at: str = "started_at", **length: int) -> DataFrame:
    """Rows of the last ``days=``/``hours=`` before ``as_of``."""
    return df.where(F.col(at) >= as_of - F.make_dt_interval(**{k: F.lit(v) for k, v in length.items()}))


def in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def with_measured_duration(runs: DataFrame) -> DataFrame:
    """Duration in seconds from the two time stamps, for logs that do not record it."""
    return runs.withColumn("duration_s", F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")))


def success_summary(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Run counts by final state and the success rate; unfinished runs are left out."""
    finished = runs.where(F.col("finished_at").isNotNull())
    counts = finished.groupBy(*keys).agg(
        F.count("*").alias("total_runs"),
        in_state(SUCCEEDED).alias("succeeded"),
        in_state(FAILED).alias("failed"),
        in_state(TIMED_OUT).alias("timed_out"),
        in_state(CANCELED).alias("canceled"),
    )
    return counts.withColumn("success_rate_pct", percent(F.col("succeeded"), F.col("total_runs")))


def duration_trend(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Average minutes of successful runs per job and day. Runs are reduced before the join."""
    usable = runs.where((F.col("state") == SUCCEEDED) & F.col("finished_at").isNotNull() & F.col("duration_s").isNotNull())
    daily = usable.groupBy("job_id", F.col("started_at").cast("date").alias("run_date")).agg(
        (mean("duration_s") / 60.0).alias("avg_duration_min")
    )
    return daily.join(jobs.select("job_id", F.col("name").alias("job_name")), "job_id").drop("job_id")


def slowest_jobs(runs: DataFrame, jobs: DataFrame, n: int = 10) -> DataFrame:
    """Top n jobs by average duration, ties by name."""
    usable = runs.where(F.col("finished_at").isNotNull() & F.col("duration_s").isNotNull())
    per_job = usable.groupBy("job_id").agg(
        F.count("*").alias("runs"),
        (mean("duration_s") / 60.0).alias("avg_duration_min"),
        (F.max("duration_s") / 60.0).alias("max_duration_min"),
        percent(in_state(SUCCEEDED), F.count("*")).alias("success_rate_pct"),
    )
    named = per_job.join(jobs.select("job_id", F.col("name").alias("job_name"), "owner"), "job_id")
    return named.orderBy(F.desc("avg_duration_min"), "job_name").limit(n).drop("job_id")


def recent_failures(runs: DataFrame, jobs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n failed runs of known jobs; runs of unknown jobs take no place."""
    bad = runs.where(F.col("state").isin(*FAILURE_STATES))
    named = bad.join(jobs.select("job_id", F.col("name").alias("job_name"), "owner"), "job_id")
    return named.orderBy(F.desc("started_at"), "run_id").limit(n)


def health_class(total: Column, failures: Column) -> Column:
    share = failures.cast("double") / total
    return (
        F.when(total == 0, "NO RUNS")
        .when((failures > 0) & (share > DEGRADED_SHARE), "DEGRADED")
        .when(failures > 0, "WATCH")
        .otherwise("HEALTHY")
    )


def job_health(runs: DataFrame, jobs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Every live job with its counts and health class. Runs are counted per job before the
    join, so the join meets one row per job and a job without runs is kept."""
    recent = since(runs, as_of, days=days)
    counts = recent.groupBy("job_id").agg(
        F.count("*").alias("total_runs"),
        in_state(SUCCEEDED).alias("successes"),
        in_state(FAILED).alias("failures"),
        in_state(TIMED_OUT).alias("timeouts"),
        F.max("started_at").alias("last_run_at"),
        (mean("duration_s") / 60.0).alias("avg_duration_min"),
    )
    live = jobs.where(F.col("deleted_at").isNull())
    zeros = {c: 0 for c in ("total_runs", "successes", "failures", "timeouts")}
    joined = live.join(counts, "job_id", "left").fillna(zeros)
    status = health_class(F.col("total_runs"), F.col("failures"))
    return joined.select(
        "job_id",
        F.col("name").alias("job_name"),
        "owner",
        *zeros,
        percent(F.col("successes"), F.col("total_runs")).alias("success_rate_pct"),
        "last_run_at",
        "avg_duration_min",
        status.alias("health_status"),
    )


def severity_rank(c: Column, order: Sequence[str] = SEVERITY_ORDER) -> Column:
    out = F.lit(len(order) + 1)
    for i, value in reversed(list(enumerate(order, start=1))):
        out = F.when(c == value, F.lit(i)).otherwise(out)
    return out


def moving_average(daily: DataFrame, order: str, measure: str, rows: int = 7, name: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Average over the row and the ``rows - 1`` before it, along one unpartitioned order.

    ``daily`` has one row per day (or run); with ``chunk`` the order is cut into pieces, so
    the numbering never runs in one task however long the log is."""
    pieces = chunk if chunk is not None else F.trunc(order, "year")

    def averaged(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.sum(F.col(measure)).over(frame) / F.count(measure).over(frame)

    return bounded_frame(daily, [], [order], {name or f"{measure}_avg_{rows}": averaged}, pieces, before=rows - 1)


def slo(runs: DataFrame, as_of: Column, limit_pct: float = 5.0, days: int = 7) -> DataFrame:
    """Freshness and breach flag from one pass over ``run_date, state, invalid_pct``."""
    recent = F.col("run_date") >= F.date_sub(as_of, days)
    invalid = F.when(recent, F.col("invalid_pct"))
    stats = runs.agg(
        F.max("run_date").alias("last_run"),
        F.max(F.when(F.col("state") == SUCCEEDED, F.col("run_date"))).alias("last_success"),
        mean(invalid).alias("invalid_pct_recent"),
        F.count_if(recent & (F.col("state") == FAILED)).alias("recent_failures"),
    )
    breached = F.coalesce(F.col("invalid_pct_recent") > limit_pct, F.lit(False)) | (F.col("recent_failures") > 0)
    return stats.select(
        "last_run",
        "last_success",
        F.datediff(as_of, "last_success").alias("days_since_success"),
        "invalid_pct_recent",
        breached.alias("slo_breached"),
    )


def alerts(one_row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per alert: its value and whether it fires. All values come from one row of
    aggregates."""
    structs = [
        F.struct(F.lit(n).alias("alert"), value.cast("double").alias("value"), F.coalesce(fired, F.lit(False)).alias("fired"))
        for n, (value, fired) in checks.items()
    ]
    return one_row.select(F.inline(F.array(*structs)))


def cost_breakdown(usage: DataFrame, kinds: Sequence[tuple[str, str]], names: Sequence[str], unit_price: float) -> DataFrame:
    """Units and cost by resource class; the first filled id column decides the class."""
    kind = F.lit("Other")
    for column, label in reversed(list(kinds)):
        kind = F.when(F.col(column).isNotNull(), F.lit(label)).otherwise(kind)
    name = F.coalesce(*[F.col(c) for c in names], F.lit("unattributed"))
    units = F.sum(F.col("quantity").cast("decimal(18,2)"))
    return usage.groupBy(kind.alias("resource_type"), name.alias("resource_name"), "sku").agg(
        units.cast("double").alias("units"), (units.cast("double") * unit_price).alias("cost")
    )


def health_status(auc: Column, max_psi: Column, open_critical: Column) -> Column:
    """Overall state of a model service: open alerts weigh most, then drift, then quality."""
    return (
        F.when(open_critical > 0, "DEGRADED")
        .when((max_psi > 0.2) | (auc < 0.8), "WATCH")
        .otherwise("HEALTHY")
    )


def volume_change(events: DataFrame, day: Column, at: str = "ts") -> DataFrame:
    """Rows of a day against the day before. One conditional aggregate over two days of data;
    the date filter reaches the scan."""
    start = day.cast("timestamp_ntz")
    window = events.where((F.col(at) >= start - F.expr("INTERVAL 1 DAY")) & (F.col(at) < start + F.expr("INTERVAL 1 DAY")))
    counts = window.agg(F.count_if(F.col(at) >= start).alias("today"), F.count_if(F.col(at) < start).alias("yesterday"))
    return counts.withColumn("pct_change", percent(F.col("today") - F.col("yesterday"), F.col("yesterday")))


def daily_profile(df: DataFrame, day: Column, column: str, decimals: int = 6) -> DataFrame:
    """count, mean, stddev, min and max of a column per day."""
    x = F.col(column).cast("double")
    return df.groupBy(day.alias("day")).agg(
        F.count(column).alias("n"),
        F.round(F.avg(x), decimals).alias("mean"),
        F.round(F.stddev_samp(x), decimals).alias("stddev"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def daily_drift(df: DataFrame, day: Column, column: str, bins: int = 10) -> DataFrame:
    """JS distance between each day and the calendar day before it, over equal-width bins of
    the whole range. Rows are counted per (day, bin) before anything else."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    cell = drift.equal_width_bin(x, F.lit(ends["lo"]), F.lit(ends["hi"]), bins)
    counts = df.where(x.isNotNull()).groupBy(day.alias("day"), cell.alias("bin")).agg(F.count("*").alias("cur"))
    shifted = counts.select(F.date_add("day", 1).alias("day"), "bin", F.col("cur").alias("ref"))
    both = counts.join(shifted, ["day", "bin"], "full_outer").fillna(0, ["cur", "ref"])
    # a day without a predecessor, or a predecessor without a day, has no pair
    sides = both.groupBy("day").agg(F.sum("cur").alias("c"), F.sum("ref").alias("r")).where("c > 0 AND r > 0").select("day")
    return drift.js_distance(both.join(sides, "day", "left_semi"), ["day"])


def profile_edges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``lo``, ``hi``: the range of each column, one small row each, to be kept with a table so
    that later profiles use the same bins."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    return ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns])))


def daily_profiles(df: DataFrame, day: Column, columns: Sequence[str], edges: DataFrame, bins: int = 10) -> DataFrame:
    """``column``, ``day``, ``bin`` with ``n``, ``total``, ``squares``, ``lo`` and ``hi``, for all columns in one scan.

    Values outside of the edges belong to the outer bins; NULLs are counted in the bin NULL. What a
    task passes on is as small as columns times days times bins."""
    known = {r["column"]: (r["lo"], r["hi"]) for r in edges.collect()}  # one row per column
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"no edges for {missing}")

    def cell(c: str) -> Column:
        x, (lo, hi) = F.col(c).cast("double"), known[c]
        place = drift.equal_width_bin(x, F.lit(lo).cast("double"), F.lit(hi).cast("double"), bins)
        return F.struct(F.lit(c).alias("column"), x.alias("x"), place.alias("bin"))

    cells = df.select(day.alias("day"), F.inline(F.array(*[cell(c) for c in columns])))
    x = F.col("x")
    return cells.groupBy("column", "day", "bin").agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )


def profile_drift(profiles: DataFrame, decimals: int = 6) -> DataFrame:
    """Per column and day: rows, share of NULLs, mean, deviation and range, and against the calendar day
    before the JS distance of the bins and the move of the mean in deviations of that day; NULL without
    such a day. Reads profiles only."""
    keys = ["column", "day"]
    filled = profiles.where("bin IS NOT NULL")
    n, total, squares = F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.sum("total"), F.sum("squares")
    days = profiles.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        (F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_share"),
        (total / n).alias("mean"),
        F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))).alias("deviation"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    counts = filled.select(*keys, "bin", F.col("n").alias("cur"))
    both = counts.join(counts.select("column", F.date_add("day", 1).alias("day"), "bin", F.col("cur").alias("ref")), [*keys, "bin"], "full_outer").fillna(0, ["cur", "ref"])
    sides = both.groupBy(*keys).agg(F.sum("cur").alias("c"), F.sum("ref").alias("r")).where("c > 0 AND r > 0").select(*keys)
    distance = drift.js_distance(both.join(sides, keys, "left_semi"), keys, decimals)
    before = days.select("column", F.date_add("day", 1).alias("day"), F.col("mean").alias("__mean"), F.col("deviation").alias("__deviation"))
    moved = F.try_divide(F.col("mean") - F.col("__mean"), F.col("__deviation"))
    joined = days.join(before, keys, "left").join(distance, keys, "left")
    return joined.select(
        *keys, "rows", *[F.round(c, decimals).alias(c) for c in ("null_share", "mean", "deviation")], "lo", "hi", "js_distance", F.round(moved, decimals).alias("mean_move")
    )
