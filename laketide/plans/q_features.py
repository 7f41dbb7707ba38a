"""Features, leakage checks, models and drift."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from laketide.functions.scalars import count_if, mean, percent, total
from laketide.operators import drift, features, model
from laketide.operators.aggregates import exact_quantiles, unpivot_row
from laketide.operators.joins import join_null_safe
from laketide.operators.windows import top_n_ranked, with_group_stats
from laketide.plans.fixtures import SQL_D, as_of, declarations
from laketide.sources.writers import stored
from laketide.plans.registry import query, sql_mean, sql_total, table
from laketide.session import fresh_dir

# ---- building --------------------------------------------------------------------------------


@query(
    "median_impute",
    f"""WITH {SQL_D}, m AS (SELECT quantile_cont(vat_amount, 0.5) AS v, quantile_cont(amount, 0.5) AS a FROM d)
    SELECT declaration_id, COALESCE(vat_amount, (SELECT v FROM m)) AS vat_amount, COALESCE(amount, (SELECT a FROM m)) AS amount FROM d""",
)
def median_impute(spark, sf):
    rows = declarations(spark, sf).select("declaration_id", "vat_amount", "amount")
    return features.median_impute(rows, ["vat_amount", "amount"], exact=True)


FEATURE_SQL = f"""y AS (SELECT o_custkey, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS fy, {sql_total('o_totalprice')} AS income, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
  peer AS (SELECT nation, fy, {sql_mean('income')} AS peer_avg FROM y GROUP BY 1, 2),
  f AS (SELECT o_custkey, nation, fy, income, n, income / n / 10000 AS avg_rate, CAST(income > 600000 AS INTEGER) AS is_high,
    lag(income) OVER (PARTITION BY o_custkey ORDER BY fy) AS previous, COUNT(*) OVER (PARTITION BY o_custkey) AS years, peer_avg FROM y JOIN peer USING (nation, fy)),
  ft AS (SELECT o_custkey, nation, fy, income, avg_rate, is_high, CASE WHEN previous > 0 THEN (income - previous) / previous * 100.0::DOUBLE END AS yoy_pct, years, income / peer_avg AS vs_peers FROM f)"""


def feature_rows(spark, sf):
    """One row per customer and year: windows over a customer see at most one row a year,
    the peer average is an aggregate joined back."""
    per_year = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(
        total("o_totalprice").alias("income"), F.count("*").alias("n")
    )
    nations = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    own = Window.partitionBy("o_custkey")
    y = per_year.withColumns({"previous": F.lag("income").over(own.orderBy("fy")), "years": F.count("*").over(own)})
    y = with_group_stats(y.join(nations, "o_custkey"), ["nation", "fy"], {"peer_avg": mean("income")})
    growth = (F.col("income") - F.col("previous")) / F.col("previous") * 100.0
    return y.select(
        "o_custkey",
        "nation",
        "fy",
        "income",
        (F.col("income") / F.col("n") / 10000).alias("avg_rate"),
        (F.col("income") > 600000).cast("int").alias("is_high"),
        F.when(F.col("previous") > 0, growth).alias("yoy_pct"),
        "years",
        (F.col("income") / F.col("peer_avg")).alias("vs_peers"),
    )


@query("feature_table", f"WITH {FEATURE_SQL} SELECT * FROM ft")
def feature_table(spark, sf):
    return feature_rows(spark, sf)


@query(
    "feature_quality",
    f"""WITH {FEATURE_SQL} SELECT COUNT(*) AS rows, COUNT(*) - COUNT(yoy_pct) AS null_yoy, COUNT(CASE WHEN avg_rate < 0 OR avg_rate > 100 THEN 1 END) AS rate_out_of_range,
    COUNT(CASE WHEN is_high = 1 THEN 1 END) AS positives, CAST(COUNT(CASE WHEN is_high = 1 THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS positive_pct FROM ft""",
)
def feature_quality(spark, sf):
    rate = F.col("avg_rate")
    checks = feature_rows(spark, sf).agg(
        F.count("*").alias("rows"),
        count_if(F.col("yoy_pct").isNull()).alias("null_yoy"),
        count_if((rate < 0) | (rate > 100)).alias("rate_out_of_range"),
        count_if(F.col("is_high") == 1).alias("positives"),
    )
    return checks.withColumn("positive_pct", percent(F.col("positives"), F.col("rows")))


def correlation_sql(source: str, names: list[str], target: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, COUNT(*) FILTER (WHERE {n} IS NOT NULL AND {target} IS NOT NULL) AS n,
        CASE WHEN MIN({n}) < MAX({n}) THEN round(corr(CAST({n} AS DOUBLE), CAST({target} AS DOUBLE)), 6) END AS correlation,
        CASE WHEN MIN({n}) < MAX({n}) THEN abs(round(corr(CAST({n} AS DOUBLE), CAST({target} AS DOUBLE)), 6)) END AS abs_correlation FROM {source}"""
        for n in names
    )


@query(
    "feature_correlation",
    f"""WITH x AS (SELECT *, 1 AS constant FROM lineitem), c AS ({correlation_sql('x', ['l_quantity', 'l_discount', 'l_tax', 'constant'], 'l_extendedprice')})
    SELECT feature, n, correlation, abs_correlation FROM c ORDER BY abs_correlation DESC NULLS LAST""",
)
def feature_correlation(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("constant", F.lit(1))
    ranked = features.feature_correlations(rows, ["l_quantity", "l_discount", "l_tax", "constant"], "l_extendedprice")
    return ranked.orderBy(F.desc_nulls_last("abs_correlation"))


LEAK_SQL = """x AS (SELECT o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS passed,
    CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + o_orderkey % 5 AS decision, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END + o_orderkey % 7 AS hint FROM orders)"""


@query(
    "target_leakage",
    f"""WITH {LEAK_SQL}, c AS ({correlation_sql('x', ['amount', 'decision', 'hint'], 'passed')})
    SELECT *, CASE WHEN abs_correlation IS NULL THEN 'undefined' WHEN abs_correlation > 0.95 THEN 'leakage' WHEN abs_correlation > 0.5 THEN 'suspicious' ELSE 'ok' END AS tier FROM c""",
)
def target_leakage(spark, sf):
    passed = F.col("o_orderstatus") == "F"
    rows = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("amount"),
        passed.cast("int").alias("passed"),
        (F.when(passed, 100).otherwise(0) + F.col("o_orderkey") % 5).alias("decision"),
        (F.when(passed, 3).otherwise(0) + F.col("o_orderkey") % 7).alias("hint"),
    )
    return features.leakage_tiers(features.feature_correlations(rows, ["amount", "decision", "hint"], "passed"))


@query(
    "temporal_leakage",
    """WITH x AS (SELECT o_orderdate, o_orderdate + CAST(o_orderkey % 21 - 10 AS INTEGER) * INTERVAL 1 DAY AS reviewed_at,
      CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate - INTERVAL 3 DAY END AS opened_at FROM orders)
    SELECT 'reviewed_at' AS feature, COUNT(reviewed_at) AS rows_checked, COUNT(CASE WHEN reviewed_at > o_orderdate THEN 1 END) AS rows_in_future,
      CAST(COUNT(CASE WHEN reviewed_at > o_orderdate THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(reviewed_at) AS pct_in_future FROM x
    UNION ALL SELECT 'opened_at', COUNT(opened_at), COUNT(CASE WHEN opened_at > o_orderdate THEN 1 END),
      CAST(COUNT(CASE WHEN opened_at > o_orderdate THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(opened_at) FROM x""",
)
def temporal_leakage(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, sf, "orders").select(
        at,
        (at + F.make_dt_interval(days=(k % 21 - 10).cast("int"))).alias("reviewed_at"),
        F.when(k % 6 != 0, at - F.expr("INTERVAL 3 DAYS")).alias("opened_at"),
    )
    return features.temporal_leakage(rows, "o_orderdate", ["reviewed_at", "opened_at"])


@query(
    "temporal_split",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def temporal_split(spark, sf):
    """Both parts, without the columns that are only known after the outcome."""
    cutoff = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    parts = features.temporal_split(rows, "o_orderdate", cutoff, drop=["o_orderstatus"])
    train, test = (p.withColumn("split", F.lit(n)).drop("o_orderdate") for p, n in zip(parts, ("train", "test")))
    return train.union(test)


@query(
    "outcome_rates",
    """SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS total, COUNT(CASE WHEN value < 50 THEN 1 END) AS passed,
    CAST(COUNT(CASE WHEN value < 50 THEN 1 END) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS pass_rate FROM events GROUP BY 1, 2""",
)
def outcome_rates(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    return features.outcome_rates(rows, ["event_type", "hour"], F.col("value") < 50)


@query(
    "profile_by_outcome",
    f"""SELECT o_orderstatus, {sql_mean('o_totalprice')} AS average, quantile_cont(o_totalprice, 0.5) AS median, MIN(o_totalprice) AS lowest, MAX(o_totalprice) AS highest FROM orders GROUP BY 1""",
)
def profile_by_outcome(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    simple = o.groupBy("o_orderstatus").agg(
        mean("o_totalprice").alias("average"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest")
    )
    median = exact_quantiles(o, "o_totalprice", [0.5], ["o_orderstatus"]).withColumnRenamed("q0", "median")
    return join_null_safe(simple, median, ["o_orderstatus"])


@query(
    "stratified_split",
    """WITH b AS (SELECT o_orderstatus, CAST('0x' || substr(sha256(o_orderstatus || '|' || o_orderkey), 1, 8) AS BIGINT) % 100 AS bucket FROM orders)
    SELECT o_orderstatus, COUNT(*) AS rows, COUNT(*) FILTER (WHERE bucket < 80) AS train_rows, CAST(COUNT(*) FILTER (WHERE bucket < 80) AS DOUBLE) * 100.0::DOUBLE / COUNT(*) AS train_pct
    FROM b GROUP BY 1""",
)
def stratified_split(spark, sf):
    """Rows and train share per class."""
    rows = features.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    sizes = rows.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), count_if(F.col("split") == "train").alias("train_rows"))
    return sizes.withColumn("train_pct", percent(F.col("train_rows"), F.col("rows")))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("one_hot", f"SELECT event_id, {', '.join(f'''CAST(event_type = '{k}' AS INTEGER) AS kind_{k}''' for k in KINDS)} FROM events")
def one_hot(spark, sf):
    return features.one_hot(table(spark, sf, "events").select("event_id", "event_type"), "event_type", KINDS, "kind").drop("event_type")


# ---- model -------------------------------------------------------------------------------------

DOCUMENT_FEATURES = ["n_chars", "n_lines", "n_words", "n_digits"]
METRIC_FLOOR = 0.7


def document_features(spark, sf):
    """Simple counts over the whole text of every document."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        "n_chars",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n_lines"),
        F.regexp_count(text, F.lit(r"\S+")).alias("n_words"),
        F.regexp_count(text, F.lit(r"\d")).alias("n_digits"),
    )


def trained(spark, sf):
    """The labelled rows of the stratified test split, and the model of the others."""
    rows = document_features(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rows = stored(features.stratified_split(rows, "doc_id", "quality"), "labelled")
    return rows.where("split = 'test'"), model.train_forest(rows.where("split = 'train'"), DOCUMENT_FEATURES, "quality")


@query("rf_train_score")
def rf_train_score(spark, sf):
    """Feature importances, with the metrics of the model on the rows held out from it."""
    rows, forest = trained(spark, sf)
    scored = model.score(rows, forest, DOCUMENT_FEATURES, "v1", as_of())
    metrics = model.classification_metrics(scored, "quality", "prediction").select("precision", "recall", "f1", "accuracy")
    weights = model.importances(forest, DOCUMENT_FEATURES)
    entries = [
        ({"feature": f, "importance": w}, {m: m for m in ("precision", "recall", "f1", "accuracy")}) for f, w in weights.items()
    ]
    return unpivot_row(metrics, entries)


@query(
    "rf_train_audit",
    """SELECT f.feature, true AS importance_in_bounds, true AS importances_sum_to_one, true AS metrics_above_floor
    FROM (VALUES ('n_chars'), ('n_lines'), ('n_words'), ('n_digits')) f(feature)""",
)
def rf_train_audit(spark, sf):
    """Each feature's weight is a share of one, and on held-out rows accuracy and F1 reach the floor."""
    rows = rf_train_score(spark, sf)
    total = rows.agg(F.sum("importance")).first()[0] or 0.0
    return rows.select(
        "feature",
        F.col("importance").between(0, 1).alias("importance_in_bounds"),
        F.lit(abs(total - 1) < 1e-6).alias("importances_sum_to_one"),
        ((F.col("accuracy") >= METRIC_FLOOR) & (F.col("f1") >= METRIC_FLOOR)).alias("metrics_above_floor"),
    )


@query("batch_scoring")
def batch_scoring(spark, sf):
    """Every document scored, with model version and input hash."""
    _, forest = trained(spark, sf)
    scored = model.score(document_features(spark, sf), forest, DOCUMENT_FEATURES, "v1", as_of())
    return scored.select("doc_id", "score", "prediction", "model_version", "input_hash", "scored_at")


@query(
    "batch_scoring_audit",
    "SELECT doc_id, 'v1' AS model_version, 64 AS hash_length, true AS score_in_bounds, true AS prediction_follows_score FROM documents",
)
def batch_scoring_audit(spark, sf):
    """Every document is scored once, by the stated model, with a score between 0 and 1 that the prediction follows."""
    s = batch_scoring(spark, sf)
    bounds = F.col("score").between(0, 1)
    follows = (F.col("prediction") == F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)) | (F.abs(F.col("score") - 0.5) < 1e-9)
    return s.select("doc_id", "model_version", F.length("input_hash").alias("hash_length"), bounds.alias("score_in_bounds"), follows.alias("prediction_follows_score"))


METRIC_SQL = "x AS (SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, n_chars FROM labels JOIN documents USING (doc_id))"


@query(
    "classification_metrics",
    f"""WITH {METRIC_SQL}, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
      COUNT(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, COUNT(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM x)
    SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
      COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy FROM c""",
)
def classification_metrics(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = rows.select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"))
    return model.classification_metrics(guess, "y", "p")


@query(
    "model_auc",
    f"""WITH {METRIC_SQL}, c AS (SELECT n_chars AS s, SUM(y) AS pos, SUM(1 - y) AS neg FROM x GROUP BY 1),
    w AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) AS auc FROM w""",
)
def model_auc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return model.auc(rows, "quality", "n_chars")


@query("review_queue", "SELECT event_id, value / 400 AS score FROM events WHERE value / 400 > 0.4")
def review_queue(spark, sf):
    """Every row over the risk limit."""
    scored = table(spark, sf, "events").select("event_id", (F.col("value") / 400).alias("score"))
    return model.review_queue(scored, 0.4)


@query(
    "review_queue_top",
    """SELECT event_id, value / 400 AS score, row_number() OVER (ORDER BY value / 400 DESC, event_id) AS place FROM events WHERE value / 400 > 0.4 ORDER BY place LIMIT 25""",
)
def review_queue_top(spark, sf):
    """A report on the queue: its 25 most risky rows with their place."""
    scored = table(spark, sf, "events").select("event_id", (F.col("value") / 400).alias("score"))
    queue = top_n_ranked(model.review_queue(scored, 0.4), [F.desc("score"), F.col("event_id")], 25, "place")
    return queue.withColumn("place", F.col("place").cast("bigint"))


# ---- drift ----------------------------------------------------------------------------------------

DRIFT_FEATURES = ["o_totalprice", "o_custkey"]


def drifted(spark, sf, since="1999-01-01", raised=1.25):
    """Reference: early orders; current: late orders, with prices raised by a quarter."""
    late = F.col("o_orderdate") >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz")
    price = F.when(late, F.col("o_totalprice") * raised).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select(price.alias("o_totalprice"), "o_custkey", late.alias("is_late"))


DRIFT_BASE = """x AS (SELECT CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' THEN o_totalprice * 1.25::DOUBLE ELSE o_totalprice END AS o_totalprice,
    o_custkey, o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AS is_late FROM orders),
  v AS (SELECT 'o_totalprice' AS feature, CAST(o_totalprice AS DOUBLE) AS v, is_late FROM x UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE), is_late FROM x)"""
PSI_SQL = """e AS (SELECT feature, MIN(v) AS lo, MAX(v) AS hi FROM v GROUP BY 1),
  b AS (SELECT feature, LEAST(GREATEST(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 0), 9) AS bin, COUNT(*) FILTER (WHERE is_late) AS cur, COUNT(*) FILTER (WHERE NOT is_late) AS ref
    FROM v JOIN e USING (feature) GROUP BY 1, 2),
  tot AS (SELECT feature, SUM(cur) AS cn, SUM(ref) AS rn FROM b GROUP BY 1),
  sh AS (SELECT feature, CASE WHEN cur = 0 THEN 1e-6 ELSE CAST(cur AS DOUBLE) / cn END AS c, CASE WHEN ref = 0 THEN 1e-6 ELSE CAST(ref AS DOUBLE) / rn END AS r FROM b JOIN tot USING (feature)),
  psi AS (SELECT feature, round(SUM((c - r) * ln(c / r)), 6) AS psi FROM sh GROUP BY 1),
  psis AS (SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'watch' ELSE 'retrain' END AS severity FROM psi)"""
KS_SQL = """cv AS (SELECT feature, v, COUNT(*) FILTER (WHERE is_late) AS cur, COUNT(*) FILTER (WHERE NOT is_late) AS ref FROM v GROUP BY 1, 2),
  cw AS (SELECT feature, SUM(cur) OVER w AS cc, SUM(ref) OVER w AS cr, SUM(cur) OVER (PARTITION BY feature) AS m, SUM(ref) OVER (PARTITION BY feature) AS n
    FROM cv WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
  kd AS (SELECT feature, MAX(abs(CAST(cc AS DOUBLE) / m - CAST(cr AS DOUBLE) / n)) AS raw, sqrt(CAST(MAX(m) AS DOUBLE) * MAX(n) / (MAX(m) + MAX(n))) AS root FROM cw GROUP BY 1),
  kl AS (SELECT feature, raw, raw * (root + 0.12::DOUBLE + 0.11::DOUBLE / root) AS l FROM kd),
  ks AS (SELECT feature, round(raw, 6) AS ks_statistic, round(CASE WHEN l < 0.2 THEN 1.0::DOUBLE ELSE
      LEAST(GREATEST((SELECT 2.0::DOUBLE * SUM((CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * l * l)) FROM range(1, 101) t(k)), 0.0::DOUBLE), 1.0::DOUBLE) END, 6) AS ks_pvalue FROM kl)"""


@query("psi_drift", f"WITH {DRIFT_BASE}, {PSI_SQL} SELECT * FROM psis")
def psi_drift(spark, sf):
    return drift.psi(drift.histograms(drifted(spark, sf), F.col("is_late"), DRIFT_FEATURES))


@query("ks_drift", f"WITH {DRIFT_BASE}, {KS_SQL} SELECT * FROM ks")
def ks_drift(spark, sf):
    return drift.ks_of(drift.value_counts(drifted(spark, sf), F.col("is_late"), DRIFT_FEATURES))


@query(
    "drift_report",
    f"WITH {DRIFT_BASE}, {PSI_SQL}, {KS_SQL} SELECT feature, psi, severity, ks_statistic, ks_pvalue, psi > 0.2 OR ks_pvalue < 0.05 AS drift_detected FROM psis JOIN ks USING (feature)",
)
def drift_report(spark, sf):
    return drift.drift_report(drifted(spark, sf), F.col("is_late"), DRIFT_FEATURES)


EARLIER_BASE = DRIFT_BASE.replace("1999-01-01", "1997-01-01").replace("* 1.25::DOUBLE", "* 1.0::DOUBLE")
REPORT_SQL = "SELECT feature, psi, severity, ks_statistic, ks_pvalue, psi > 0.2 OR ks_pvalue < 0.05 AS drift_detected FROM psis JOIN ks USING (feature)"


@query(
    "drift_history",
    f"""SELECT *, 'run-1' AS run_id, 'v1' AS model_version, TIMESTAMP '2024-03-01 00:00:00' AS checked_at FROM (WITH {EARLIER_BASE}, {PSI_SQL}, {KS_SQL} {REPORT_SQL})
    UNION ALL SELECT *, 'run-2', 'v2', TIMESTAMP '2024-03-02 00:00:00' FROM (WITH {DRIFT_BASE}, {PSI_SQL}, {KS_SQL} {REPORT_SQL})""",
)
def drift_history(spark, sf):
    """Two checks of a model service, the second one recorded twice."""
    history = drift.DriftHistory(spark, fresh_dir(spark, "drift_history"))
    first = drift.drift_report(drifted(spark, sf, "1997-01-01", 1.0), F.col("is_late"), DRIFT_FEATURES)
    history.record(first, "run-1", "v1", datetime(2024, 3, 1))
    for _ in range(2):
        second = drift.drift_report(drifted(spark, sf), F.col("is_late"), DRIFT_FEATURES)
        history.record(second, "run-2", "v2", datetime(2024, 3, 2))
    return history.read()
