"""Monitoring reports over run logs derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions.scalars import mean, percent
from laketide.operators import drift
from laketide.operators import monitoring as mon
from laketide.plans.fixtures import AS_OF, SQL_DAILY, SQL_J, SQL_R, as_of, daily_runs, jobs, runs
from laketide.plans.registry import query, sql_mean, table

NOW = f"TIMESTAMP '{AS_OF}'"
STATES_SQL = """COUNT(*) AS total_runs, COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS succeeded, COUNT(CASE WHEN state = 'FAILED' THEN 1 END) AS failed,
    COUNT(CASE WHEN state = 'TIMEDOUT' THEN 1 END) AS timed_out, COUNT(CASE WHEN state = 'CANCELED' THEN 1 END) AS canceled,
    CAST(COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / NULLIF(COUNT(*), 0) AS success_rate_pct"""


@query("success_rate", f"WITH {SQL_R} SELECT {STATES_SQL} FROM r WHERE started_at >= {NOW} - INTERVAL 7 DAY AND finished_at IS NOT NULL")
def success_rate(spark, sf):
    return mon.success_summary(mon.since(runs(spark, sf), as_of(), days=7))


@query(
    "daily_success_trend",
    f"WITH {SQL_R} SELECT CAST(started_at AS DATE) AS run_date, {STATES_SQL} FROM r WHERE started_at >= {NOW} - INTERVAL 30 DAY AND finished_at IS NOT NULL GROUP BY 1",
)
def daily_success_trend(spark, sf):
    recent = mon.since(runs(spark, sf), as_of(), days=30)
    return mon.success_summary(recent.withColumn("run_date", F.col("started_at").cast("date")), ["run_date"])


@query(
    "duration_trend",
    f"""WITH {SQL_R}, {SQL_J} SELECT name AS job_name, CAST(started_at AS DATE) AS run_date, {sql_mean('duration_s')} / 60.0::DOUBLE AS avg_duration_min
    FROM r JOIN j USING (job_id) WHERE started_at >= {NOW} - INTERVAL 30 DAY AND finished_at IS NOT NULL AND state = 'SUCCEEDED' GROUP BY 1, 2""",
)
def duration_trend(spark, sf):
    return mon.duration_trend(mon.since(runs(spark, sf), as_of(), days=30), jobs(spark, sf))


@query(
    "slowest_jobs",
    f"""WITH {SQL_R}, {SQL_J} SELECT name AS job_name, owner, COUNT(*) AS runs, {sql_mean('duration_s')} / 60.0::DOUBLE AS avg_duration_min, MAX(duration_s) / 60.0::DOUBLE AS max_duration_min,
    CAST(COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS success_rate_pct
    FROM r JOIN j USING (job_id) WHERE started_at >= {NOW} - INTERVAL 7 DAY AND finished_at IS NOT NULL GROUP BY 1, 2 ORDER BY avg_duration_min DESC, job_name LIMIT 10""",
)
def slowest_jobs(spark, sf):
    return mon.slowest_jobs(mon.since(runs(spark, sf), as_of(), days=7), jobs(spark, sf))


@query(
    "recent_failures",
    f"""WITH {SQL_R}, {SQL_J}, f AS (SELECT * FROM r JOIN j USING (job_id) WHERE started_at >= {NOW} - INTERVAL 24 HOUR AND state IN ('FAILED', 'TIMEDOUT', 'ERROR') ORDER BY started_at DESC, run_id LIMIT 50)
    SELECT name AS job_name, owner, run_id, started_at, state, duration_s / 60 AS duration_min FROM f""",
)
def recent_failures(spark, sf):
    bad = mon.recent_failures(mon.since(runs(spark, sf), as_of(), hours=24), jobs(spark, sf))
    return bad.select("job_name", "owner", "run_id", "started_at", "state", (F.col("duration_s") / 60).alias("duration_min"))


@query(
    "task_drilldown",
    f"WITH {SQL_R} SELECT run_id, started_at, state, duration_s / 60 AS duration_min FROM r WHERE job_id = 3 AND started_at >= {NOW} - INTERVAL 7 DAY",
)
def task_drilldown(spark, sf):
    mine = mon.since(runs(spark, sf).where("job_id = 3"), as_of(), days=7)
    return mine.select("run_id", "started_at", "state", (F.col("duration_s") / 60).alias("duration_min")).orderBy(F.desc("started_at"), "run_id")


@query(
    "job_health",
    f"""WITH {SQL_R}, {SQL_J}, s AS (SELECT j.job_id, name AS job_name, owner, COUNT(run_id) AS total_runs, COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS successes,
      COUNT(CASE WHEN state = 'FAILED' THEN 1 END) AS failures, COUNT(CASE WHEN state = 'TIMEDOUT' THEN 1 END) AS timeouts, MAX(started_at) AS last_run_at, {sql_mean('duration_s')} / 60.0::DOUBLE AS avg_duration_min
      FROM j LEFT JOIN r ON j.job_id = r.job_id AND started_at >= {NOW} - INTERVAL 7 DAY WHERE deleted_at IS NULL GROUP BY 1, 2, 3)
    SELECT *, CAST(successes AS DOUBLE) * 100.0::DOUBLE / NULLIF(total_runs, 0) AS success_rate_pct, CASE WHEN total_runs = 0 THEN 'NO RUNS' WHEN failures > 0 AND CAST(failures AS DOUBLE) / total_runs > 0.2 THEN 'DEGRADED' WHEN failures > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status FROM s""",
)
def job_health(spark, sf):
    health = mon.job_health(runs(spark, sf), jobs(spark, sf), as_of())
    order = mon.severity_rank(F.col("health_status"), ("DEGRADED", "WATCH", "HEALTHY", "NO RUNS"))
    return health.orderBy(order, F.desc("failures"))


@query(
    "update_health",
    f"""WITH {SQL_R}, {SQL_J}, s AS (SELECT j.job_id, name AS job_name, owner, COUNT(run_id) AS total_runs, COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS successes,
      COUNT(CASE WHEN state = 'FAILED' THEN 1 END) AS failures, COUNT(CASE WHEN state = 'TIMEDOUT' THEN 1 END) AS timeouts, MAX(started_at) AS last_run_at,
      CAST(SUM(CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000000) AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT(finished_at), 0) / 60.0::DOUBLE AS avg_duration_min
      FROM j LEFT JOIN r ON j.job_id = r.job_id AND started_at >= {NOW} - INTERVAL 3 DAY WHERE deleted_at IS NULL GROUP BY 1, 2, 3)
    SELECT *, CAST(successes AS DOUBLE) * 100.0::DOUBLE / NULLIF(total_runs, 0) AS success_rate_pct, CASE WHEN total_runs = 0 THEN 'NO RUNS' WHEN failures > 0 AND CAST(failures AS DOUBLE) / total_runs > 0.2 THEN 'DEGRADED' WHEN failures > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status FROM s""",
)
def update_health(spark, sf):
    """The same report for a log without a duration column, over three days."""
    return mon.job_health(mon.with_measured_duration(runs(spark, sf)), jobs(spark, sf), as_of(), days=3)


@query(
    "cost_breakdown",
    """WITH u AS (SELECT CASE WHEN event_type = 'click' THEN 'job' || CAST(user_id % 10 AS VARCHAR) END AS job_name, CASE WHEN event_type IN ('view', 'signup') THEN 'wh' || CAST(user_id % 3 AS VARCHAR) END AS warehouse_name,
      'SKU_' || CAST(event_id % 2 AS VARCHAR) AS sku, value AS quantity FROM events)
    SELECT CASE WHEN job_name IS NOT NULL THEN 'Job' WHEN warehouse_name IS NOT NULL THEN 'SQL Warehouse' ELSE 'Other' END AS resource_type, COALESCE(job_name, warehouse_name, 'unattributed') AS resource_name, sku,
    CAST(SUM(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS units, CAST(SUM(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) * 0.4::DOUBLE AS cost FROM u GROUP BY 1, 2, 3""",
)
def cost_breakdown(spark, sf):
    user, kind = F.col("user_id"), F.col("event_type")
    usage = table(spark, sf, "events").select(
        F.when(kind == "click", F.concat(F.lit("job"), (user % 10).cast("string"))).alias("job_name"),
        F.when(kind.isin("view", "signup"), F.concat(F.lit("wh"), (user % 3).cast("string"))).alias("warehouse_name"),
        F.concat(F.lit("SKU_"), (F.col("event_id") % 2).cast("string")).alias("sku"),
        F.col("value").alias("quantity"),
    )
    kinds = [("job_name", "Job"), ("warehouse_name", "SQL Warehouse")]
    return mon.cost_breakdown(usage, kinds, ["job_name", "warehouse_name"], 0.4)


@query(
    "run_kpi_summary",
    f"""WITH {SQL_DAILY} SELECT COUNT(*) AS total_runs, CAST(COUNT(CASE WHEN state = 'SUCCEEDED' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS success_rate_pct,
    {sql_mean('duration_s')} AS avg_duration_s, CAST(SUM(rows_ingested) AS BIGINT) AS rows_ingested, CAST(SUM(rows_quarantined) AS BIGINT) AS rows_quarantined
    FROM dr WHERE run_date >= DATE '2024-01-31' - 30""",
)
def run_kpi_summary(spark, sf):
    recent = daily_runs(spark, sf).where(F.col("run_date") >= F.date_sub(as_of().cast("date"), 30))
    return recent.agg(
        F.count("*").alias("total_runs"),
        percent(mon.in_state(mon.SUCCEEDED), F.count("*")).alias("success_rate_pct"),
        mean("duration_s").alias("avg_duration_s"),
        F.sum("rows_ingested").alias("rows_ingested"),
        F.sum("rows_quarantined").alias("rows_quarantined"),
    )


@query(
    "moving_avg_7",
    f"""WITH {SQL_DAILY} SELECT run_date, rows_ingested, CAST(SUM(rows_ingested) OVER w AS DOUBLE) / COUNT(rows_ingested) OVER w AS rows_7_avg
    FROM dr WINDOW w AS (ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def moving_avg_7(spark, sf):
    daily = daily_runs(spark, sf).select("run_date", "rows_ingested")
    return mon.moving_average(daily, "run_date", "rows_ingested", 7, "rows_7_avg")


@query(
    "slo_breach",
    f"""WITH {SQL_DAILY}, s AS (SELECT MAX(run_date) AS last_run, MAX(CASE WHEN state = 'SUCCEEDED' THEN run_date END) AS last_success FROM dr)
    SELECT last_run, last_success, CAST(date_diff('day', last_success, DATE '2024-01-31') AS INTEGER) AS days_since_success,
    (SELECT {sql_mean('pct')} FROM (SELECT CAST(invalid_pct AS DECIMAL(18,2)) AS pct FROM dr WHERE run_date >= DATE '2024-01-31' - 7)) AS invalid_pct_recent,
    COALESCE((SELECT {sql_mean('pct')} FROM (SELECT CAST(invalid_pct AS DECIMAL(18,2)) AS pct FROM dr WHERE run_date >= DATE '2024-01-31' - 7)) > 5.0, false)
      OR EXISTS (SELECT 1 FROM dr WHERE state = 'FAILED' AND run_date >= DATE '2024-01-31' - 7) AS slo_breached FROM s""",
)
def slo_breach(spark, sf):
    return mon.slo(daily_runs(spark, sf), as_of().cast("date"))


@query(
    "alert_checks",
    f"""WITH {SQL_R}, a AS (SELECT CAST(COUNT(CASE WHEN state = 'FAILED' AND started_at >= {NOW} - INTERVAL 1 HOUR THEN 1 END) AS DOUBLE) AS failures,
      CAST(floor((epoch_us({NOW}) - epoch_us(MAX(started_at))) / 60000000) AS DOUBLE) AS stale, CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(CASE WHEN state = 'FAILED' AND started_at >= {NOW} - INTERVAL 7 DAY THEN 1 END) AS DOUBLE) AS spike FROM r)
    SELECT 'failures_last_hour' AS alert, failures AS value, failures > 0 AS fired FROM a UNION ALL SELECT 'minutes_since_last', stale, stale > 60 FROM a
    UNION ALL SELECT 'empty_table', n, n = 0 FROM a UNION ALL SELECT 'failure_spike_7d', spike, spike > 100 FROM a""",
)
def alert_checks(spark, sf):
    """Four alert conditions from one aggregate."""
    bad = F.col("state") == mon.FAILED
    facts = runs(spark, sf).agg(
        F.count_if(bad & (F.col("started_at") >= as_of() - F.expr("INTERVAL 1 HOUR"))).alias("failures"),
        F.timestamp_diff("MINUTE", F.max("started_at"), as_of()).alias("stale"),
        F.count("*").alias("n"),
        F.count_if(bad & (F.col("started_at") >= as_of() - F.expr("INTERVAL 7 DAYS"))).alias("spike"),
    )
    return mon.alerts(
        facts,
        {
            "failures_last_hour": (F.col("failures"), F.col("failures") > 0),
            "minutes_since_last": (F.col("stale"), F.col("stale") > 60),
            "empty_table": (F.col("n"), F.col("n") == 0),
            "failure_spike_7d": (F.col("spike"), F.col("spike") > 100),
        },
    )


@query(
    "volume_day_over_day",
    """WITH c AS (SELECT COUNT(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20') AS today, COUNT(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-19') AS yesterday FROM events)
    SELECT today, yesterday, CAST(today - yesterday AS DOUBLE) * 100.0::DOUBLE / yesterday AS pct_change FROM c""",
)
def volume_day_over_day(spark, sf):
    return mon.volume_change(table(spark, sf, "events"), F.lit("2024-01-20").cast("date"))


HEALTH_SQL = """h AS (SELECT ts >= TIMESTAMP '2024-01-16 00:00:00' AS is_late, value AS v FROM events), e AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM h),
  b AS (SELECT LEAST(GREATEST(CAST(floor((v - (SELECT lo FROM e)) / ((SELECT hi FROM e) - (SELECT lo FROM e)) * 10) AS INTEGER), 0), 9) AS bin, COUNT(*) FILTER (WHERE is_late) AS cur, COUNT(*) FILTER (WHERE NOT is_late) AS ref FROM h GROUP BY 1),
  t AS (SELECT SUM(cur) AS cn, SUM(ref) AS rn FROM b),
  p AS (SELECT round(SUM((c - r) * ln(c / r)), 6) AS psi FROM (SELECT CASE WHEN cur = 0 THEN 1e-6 ELSE CAST(cur AS DOUBLE) / cn END AS c, CASE WHEN ref = 0 THEN 1e-6 ELSE CAST(ref AS DOUBLE) / rn END AS r FROM b, t))"""


@query(
    "health_card",
    f"""WITH {HEALTH_SQL}, f AS (SELECT CAST(COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) / 100.0::DOUBLE AS quality, COUNT(CASE WHEN event_type = 'error' AND value > 400 THEN 1 END) AS open_critical FROM events)
    SELECT quality, psi AS max_psi, open_critical, CASE WHEN open_critical > 0 THEN 'DEGRADED' WHEN psi > 0.2 OR quality < 0.8 THEN 'WATCH' ELSE 'HEALTHY' END AS overall_status FROM f, p""",
)
def health_card(spark, sf):
    """Quality, drift and open alerts in one row; drift is one number, carried as a literal."""
    e = table(spark, sf, "events")
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    worst = drift.psi(drift.histograms(e, late, ["value"])).agg(F.max("psi")).first()[0]
    error = F.col("event_type") == "error"
    facts = e.agg(
        (percent(F.count_if(~error), F.count("*")) / 100.0).alias("quality"),
        F.lit(worst).alias("max_psi"),
        F.count_if(error & (F.col("value") > 400)).alias("open_critical"),
    )
    return facts.withColumn("overall_status", mon.health_status(F.col("quality"), F.col("max_psi"), F.col("open_critical")))


@query(
    "agg_filter_alert",
    """SELECT MAX(value) AS max_value, COUNT(*) FILTER (WHERE value > 200) AS critical FROM events WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events)""",
)
def agg_filter_alert(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("lt_events_alert")
    return spark.sql(
        """SELECT MAX(value) AS max_value, COUNT(*) FILTER (WHERE value > 200) AS critical FROM lt_events_alert
        WHERE ts >= (SELECT date_trunc('DAY', MAX(ts)) FROM lt_events_alert)"""
    )


@query(
    "profile_daily",
    "SELECT CAST(ts AS DATE) AS day, COUNT(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, MIN(value) AS min, MAX(value) AS max FROM events GROUP BY 1",
)
def profile_daily(spark, sf):
    return mon.daily_profile(table(spark, sf, "events"), F.col("ts").cast("date"), "value")


@query(
    "profile_drift_daily",
    """WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
    c AS (SELECT CAST(ts AS DATE) AS day, LEAST(GREATEST(CAST(floor((value - (SELECT lo FROM e)) / ((SELECT hi FROM e) - (SELECT lo FROM e)) * 10) AS INTEGER), 0), 9) AS bin, COUNT(*) AS n FROM events GROUP BY 1, 2),
    p AS (SELECT COALESCE(a.day, CAST(b.day + INTERVAL 1 DAY AS DATE)) AS day, COALESCE(a.n, 0) AS cur, COALESCE(b.n, 0) AS ref FROM c a FULL OUTER JOIN c b ON a.day = CAST(b.day + INTERVAL 1 DAY AS DATE) AND a.bin = b.bin),
    s AS (SELECT day, CAST(cur AS DOUBLE) / SUM(cur) OVER (PARTITION BY day) AS c, CAST(ref AS DOUBLE) / SUM(ref) OVER (PARTITION BY day) AS r, SUM(cur) OVER (PARTITION BY day) AS cn, SUM(ref) OVER (PARTITION BY day) AS rn FROM p)
    SELECT day, round(sqrt(GREATEST(SUM((CASE WHEN c > 0 THEN c * log2(c / ((c + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((c + r) / 2)) ELSE 0 END) / 2), 0)), 6) AS js_distance FROM s WHERE cn > 0 AND rn > 0 GROUP BY day""",
)
def profile_drift_daily(spark, sf):
    return mon.daily_drift(table(spark, sf, "events"), F.col("ts").cast("date"), "value")


@query(
    "profile_drift_columns",
    """WITH v AS (SELECT 'value' AS col, CAST(ts AS DATE) AS day, CASE WHEN event_type <> 'error' THEN CAST(value AS DOUBLE) END AS x FROM events
      UNION ALL SELECT 'user_id', CAST(ts AS DATE), CAST(user_id AS DOUBLE) FROM events),
    e AS (SELECT col, MIN(x) AS lo, MAX(x) AS hi FROM v GROUP BY 1),
    d AS (SELECT col, day, COUNT(*) AS rows, CAST(COUNT(*) - COUNT(x) AS DOUBLE) / COUNT(*) AS null_share, AVG(x) AS mean, stddev_pop(x) AS deviation, MIN(x) AS lo, MAX(x) AS hi FROM v GROUP BY 1, 2),
    c AS (SELECT col, day, LEAST(GREATEST(CAST(floor((x - e.lo) / (e.hi - e.lo) * 10) AS INTEGER), 0), 9) AS bin, COUNT(*) AS n FROM v JOIN e USING (col) WHERE x IS NOT NULL GROUP BY 1, 2, 3),
    p AS (SELECT COALESCE(a.col, b.col) AS col, COALESCE(a.day, CAST(b.day + INTERVAL 1 DAY AS DATE)) AS day, COALESCE(a.n, 0) AS cur, COALESCE(b.n, 0) AS ref
      FROM c a FULL OUTER JOIN c b ON a.col = b.col AND a.day = CAST(b.day + INTERVAL 1 DAY AS DATE) AND a.bin = b.bin),
    s AS (SELECT col, day, CAST(cur AS DOUBLE) / SUM(cur) OVER w AS c, CAST(ref AS DOUBLE) / SUM(ref) OVER w AS r, SUM(cur) OVER w AS cn, SUM(ref) OVER w AS rn FROM p WINDOW w AS (PARTITION BY col, day)),
    j AS (SELECT col, day, round(sqrt(GREATEST(SUM((CASE WHEN c > 0 THEN c * log2(c / ((c + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((c + r) / 2)) ELSE 0 END) / 2), 0)), 6) AS js FROM s WHERE cn > 0 AND rn > 0 GROUP BY 1, 2)
    SELECT d.col AS "column", d.day, d.rows, round(d.null_share, 3) AS null_share, round(d.mean, 3) AS mean, round(d.deviation, 3) AS deviation, d.lo, d.hi, js AS js_distance, round((d.mean - b.mean) / NULLIF(b.deviation, 0), 3) AS mean_move
    FROM d LEFT JOIN d b ON b.col = d.col AND d.day = CAST(b.day + INTERVAL 1 DAY AS DATE) LEFT JOIN j ON j.col = d.col AND j.day = d.day""",
)
def profile_drift_columns(spark, sf):
    """Daily profiles of two columns from one scan, and their drift from day to day."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    events = table(spark, sf, "events").select("ts", value.alias("value"), "user_id")
    edges = mon.profile_edges(events, ["value", "user_id"])
    profiles = mon.daily_profiles(events, F.col("ts").cast("date"), ["value", "user_id"], edges)
    out = mon.profile_drift(profiles)
    return out.withColumns({c: F.round(c, 3) for c in ("null_share", "mean", "deviation", "mean_move")})
