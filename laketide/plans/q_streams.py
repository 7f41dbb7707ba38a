"""Streaming queries. The event table is staged as several files that arrive one after the
other; each stream runs until nothing is left, then its stored result is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from laketide.functions.scalars import money
from laketide.operators import quality as dq
from laketide.plans.q_changes import by_status, order_feed
from laketide.plans.q_basics import VERSION_SQL, order_versions
from laketide.plans.registry import query, sql_mean, sql_total, table
from laketide.session import fresh_dir
from laketide.sources.evolution import GrowingTable, read_merged
from laketide.sources.writers import stored
from laketide.streaming import runners, windows
from laketide.streaming.batches import DeltaSink, GroupSink, GroupTotals, UpsertSink
from laketide.streaming.layers import Layer, StreamLayers

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
SLICES = 3


def stage(df, path: str, order: str, slices: int = SLICES, only: range | None = None) -> None:
    """Write ``df`` in slices of ascending ``order``, oldest first."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // slices + 1
    for i in only if only is not None else range(slices):
        part = df.where((F.col(order) >= low + i * step) & (F.col(order) < low + (i + 1) * step))
        part.write.mode("append").parquet(path)


def feed_slices(df, root: str, order: str, start) -> None:
    """The slices arrive one after the other; after each, ``start`` opens the stream on the
    same checkpoint and it runs until nothing is left."""
    for i in range(SLICES):
        stage(df, f"{root}/landing", order, only=range(i, i + 1))
        runners.await_all([start()])


def event_rows(spark, sf):
    return table(spark, sf, "events").drop("props")


@query(
    "stream_file_ingest",
    """SELECT COUNT(*) AS rows, COUNT(DISTINCT event_id) AS ids, true AS several_files, true AS grew_only_by_new, true AS last_run_added_nothing FROM events""",
)
def stream_file_ingest(spark, sf):
    """Two slices, a run, one more slice, a second run, a third run with nothing new."""
    root = fresh_dir(spark, "ingest")
    source = event_rows(spark, sf)

    def run():
        stream = runners.file_stream(spark, f"{root}/landing", "parquet", EVENT_SCHEMA)
        runners.await_all([runners.append_to(stream, f"{root}/bronze", f"{root}/checkpoint")])
        return spark.read.parquet(f"{root}/bronze").count()

    stage(source, f"{root}/landing", "event_id", only=range(2))
    first = run()
    stage(source, f"{root}/landing", "event_id", only=range(2, SLICES))
    second, third = run(), run()
    landed = spark.read.schema(EVENT_SCHEMA).parquet(f"{root}/landing").count()
    result = spark.read.parquet(f"{root}/bronze").agg(
        F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"), (F.countDistinct("_source_file") >= SLICES).alias("several_files")
    )
    return result.withColumns(
        {"grew_only_by_new": F.lit(first < second == landed), "last_run_added_nothing": F.lit(second == third)}
    )


@query("stream_table_source", f"SELECT event_type, COUNT(*) AS n, {sql_total('value')} AS amount FROM events WHERE value > 10 GROUP BY 1")
def stream_table_source(spark, sf):
    root = fresh_dir(spark, "table_stream")
    stage(event_rows(spark, sf), f"{root}/table", "event_id")
    stream = runners.table_stream(spark, f"{root}/table", EVENT_SCHEMA).where("value > 10")
    runners.await_all([runners.append_to(stream, f"{root}/out", f"{root}/checkpoint")])
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("amount"))


@query(
    "stream_multi_source",
    "SELECT 'events' AS source, COUNT(*) AS rows FROM events UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'customers', COUNT(*) FROM customer",
)
def stream_multi_source(spark, sf):
    """Three streams are started together and awaited."""
    root = fresh_dir(spark, "multi")
    sources = {"events": ("events", "event_id"), "orders": ("orders", "o_orderkey"), "customers": ("customer", "c_custkey")}
    started = []
    for name, (source, key) in sources.items():
        rows = table(spark, sf, source)
        stage(rows, f"{root}/{name}/landing", key, slices=2)
        stream = runners.table_stream(spark, f"{root}/{name}/landing", rows.schema)
        started.append(runners.append_to(stream, f"{root}/{name}/bronze", f"{root}/{name}/checkpoint"))
    runners.await_all(started)
    out = None
    for name in sources:
        counts = spark.read.parquet(f"{root}/{name}/bronze").agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows")
        out = counts if out is None else out.union(counts)
    return out


@query(
    "stream_evolve_columns",
    """SELECT event_id, value, CASE WHEN event_id > (SELECT MIN(event_id) + 2 * ((MAX(event_id) - MIN(event_id)) // 3 + 1) - 1 FROM events) THEN event_type END AS event_type FROM events""",
)
def stream_evolve_columns(spark, sf):
    """The last file brings a new column; the stream is restarted on the same checkpoint."""
    root = fresh_dir(spark, "evolve_stream")

    def run():
        stream = runners.evolving_stream(spark, f"{root}/landing")
        runners.await_all([runners.append_to(stream, f"{root}/out", f"{root}/checkpoint")])

    rows = event_rows(spark, sf)
    stage(rows.select("event_id", "value"), f"{root}/landing", "event_id", only=range(2))
    run()
    stage(rows.select("event_id", "value", "event_type"), f"{root}/landing", "event_id", only=range(2, SLICES))
    run()
    return read_merged(spark, f"{root}/out")


def event_stream(spark, root):
    return windows.with_event_time(runners.table_stream(spark, f"{root}/landing", EVENT_SCHEMA), "ts")


def group_results(spark, sf, root, keys, aggregate):
    """A streaming aggregate in update mode, fed slice by slice."""
    sinks = []

    def start():
        agg = aggregate(event_stream(spark, root))
        sinks.append(GroupSink(spark, f"{root}/out", agg.schema, keys))
        return runners.run_batches(agg, sinks[-1], f"{root}/checkpoint", mode="update")

    feed_slices(event_rows(spark, sf), root, "event_id", start)
    return sinks[-1].current()


def value_aggs():
    exact = F.sum(money("value")).cast("double")
    return [F.count("*").alias("events"), (exact / F.count("value")).alias("avg_value"), F.max("value").alias("max_value")]


@query(
    "stream_tumbling_agg",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type,
    COUNT(*) AS events, {sql_mean('value')} AS avg_value, MAX(value) AS max_value FROM events GROUP BY 1, 2, 3""",
)
def stream_tumbling_agg(spark, sf):
    """Hourly windows with a watermark, in update mode over three restarts."""
    return group_results(
        spark, sf, fresh_dir(spark, "tumbling"), ["window_start", "window_end", "event_type"],
        lambda e: windows.tumbling(e, "ts", "1 hour", "2 minutes", ["event_type"], value_aggs()),
    )


@query(
    "stream_tumbling_append",
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, COUNT(*) AS events, {sql_mean('value')} AS avg_value, MAX(value) AS max_value
    FROM events GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 2 MINUTE""",
)
def stream_tumbling_append(spark, sf):
    """Append mode: only windows the watermark has closed are written, each exactly once."""
    root = fresh_dir(spark, "tumbling_append")

    def start():
        agg = windows.tumbling(event_stream(spark, root), "ts", "1 day", "2 minutes", ["event_type"], value_aggs())
        return runners.append_to(agg, f"{root}/out", f"{root}/checkpoint")

    feed_slices(event_rows(spark, sf), root, "event_id", start)
    return spark.read.parquet(f"{root}/out")


@query("stream_keyed_agg", f"SELECT user_id, COUNT(*) AS events, {sql_mean('value')} AS avg_value, MAX(value) AS max_value FROM events GROUP BY 1")
def stream_keyed_agg(spark, sf):
    return group_results(
        spark, sf, fresh_dir(spark, "keyed"), ["user_id"], lambda e: windows.keyed(e, "ts", "1 hour", ["user_id"], value_aggs())
    )


@query(
    "stream_alerts",
    "SELECT event_id, user_id, value, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS alert_severity FROM events WHERE value > 80",
)
def stream_alerts(spark, sf):
    root = fresh_dir(spark, "alerts")

    def start():
        stream = windows.alerts(event_stream(spark, root), "value", 80, 100)
        return runners.append_to(stream.select("event_id", "user_id", "value", "alert_severity"), f"{root}/out", f"{root}/checkpoint")

    feed_slices(event_rows(spark, sf), root, "event_id", start)
    return spark.read.parquet(f"{root}/out")


# ---- micro-batches -----------------------------------------------------------------------------

REQUEST_SCHEMA = "request_id bigint, seen_at timestamp_ntz, event_id bigint, outcome string, minutes double"


def requests(spark, sf):
    """Service requests: an id comes back in later events, outcomes may be unknown."""
    outcome = F.when(F.col("event_id") % 40 == 7, F.lit("???")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        (F.col("event_id") % 4000).alias("request_id"), F.col("ts").alias("seen_at"), "event_id", outcome.alias("outcome"), F.col("value").alias("minutes")
    )


REQUEST_SQL = """q AS (SELECT event_id % 4000 AS request_id, ts AS seen_at, event_id, CASE WHEN event_id % 40 = 7 THEN '???' ELSE event_type END AS outcome, value AS minutes FROM events),
  cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seen_at DESC, event_id DESC) AS rn FROM q WHERE outcome <> '???') WHERE rn = 1)"""
OUTCOMES = ["click", "error", "purchase", "signup", "view"]


def request_sink(spark, root, publish=None, gold=None, buckets=0):
    schema = spark.createDataFrame([], REQUEST_SCHEMA).schema
    rules = [dq.Rule("key", F.col("request_id").isNull()), dq.Rule("outcome", ~F.col("outcome").isin(*OUTCOMES))]
    return UpsertSink(spark, f"{root}/silver", schema, ["request_id"], ["seen_at", "event_id"], rules, publish, gold=gold, buckets=buckets)


def start_requests(spark, root, sink, checkpoint="checkpoint"):
    stream = runners.table_stream(spark, f"{root}/landing", REQUEST_SCHEMA)
    return runners.run_batches(stream, sink, f"{root}/{checkpoint}")


@query(
    "stream_dq_upsert",
    f"""WITH {REQUEST_SQL} SELECT outcome, COUNT(*) AS requests, {sql_mean('minutes')} AS avg_minutes, (SELECT COUNT(*) FROM q WHERE outcome = '???') AS quarantined FROM cur GROUP BY 1""",
)
def stream_dq_upsert(spark, sf):
    """Split, quarantine, dedup, upsert, gold by retraction, log."""
    root = fresh_dir(spark, "upsert")
    gold = request_gold(spark, root, {"outcome": F.col("outcome")})
    sink = request_sink(spark, root, gold=gold, buckets=8)
    feed_slices(requests(spark, sf), root, "event_id", lambda: start_requests(spark, root, sink))
    bad = sink.log.read().agg(F.sum("rows_quarantined")).first()[0]
    mean = F.col("minutes").cast("double") / F.col("minutes_n")
    return gold.current(sink.log.last()).select("outcome", F.col("rows").alias("requests"), mean.alias("avg_minutes"), F.lit(bad).cast("bigint").alias("quarantined"))


def request_gold(spark, root, groups, extremes=None):
    schema = spark.createDataFrame([], REQUEST_SCHEMA).schema
    return GroupTotals(spark, f"{root}/gold", schema, groups, {"minutes": money("minutes")}, extremes, buckets=8)


@query(
    "stream_gold_retraction",
    f"""WITH {REQUEST_SQL} SELECT outcome, request_id % 97 AS office, COUNT(*) AS requests, {sql_total('minutes')} AS minutes, MIN(minutes) AS shortest, MAX(minutes) AS longest,
    MIN(seen_at) AS first_seen, MAX(seen_at) AS last_seen FROM cur GROUP BY 1, 2""",
)
def stream_gold_retraction(spark, sf):
    """Totals and extremes of many groups while rows move between them; compacted on the way."""
    root = fresh_dir(spark, "retraction")
    extremes = {"span": F.col("minutes"), "seen": F.col("seen_at")}
    gold = request_gold(spark, root, {"outcome": F.col("outcome"), "office": F.col("request_id") % 97}, extremes)
    sink = request_sink(spark, root, gold=gold, buckets=8)
    stage(requests(spark, sf), f"{root}/landing", "event_id", only=range(2))
    runners.await_all([start_requests(spark, root, sink)])
    sink.compact()
    gold.compact(sink.log.last())
    stage(requests(spark, sf), f"{root}/landing", "event_id", only=range(2, SLICES))
    runners.await_all([start_requests(spark, root, sink)])
    return gold.current(sink.log.last()).select(
        "outcome",
        "office",
        F.col("rows").alias("requests"),
        F.col("minutes").cast("double").alias("minutes"),
        F.col("span_min").alias("shortest"),
        F.col("span_max").alias("longest"),
        F.col("seen_min").alias("first_seen"),
        F.col("seen_max").alias("last_seen"),
    )


@query("stream_upsert_state", f"WITH {REQUEST_SQL} SELECT * FROM cur")
def stream_upsert_state(spark, sf):
    """The whole state, read over a compacted base and a later batch."""
    root = fresh_dir(spark, "upsert_state")
    sink = request_sink(spark, root)
    stage(requests(spark, sf), f"{root}/landing", "event_id", only=range(2))
    runners.await_all([start_requests(spark, root, sink)])
    sink.compact()
    stage(requests(spark, sf), f"{root}/landing", "event_id", only=range(2, SLICES))
    runners.await_all([start_requests(spark, root, sink)])
    return sink.current()


@query(
    "stream_idempotent",
    f"WITH {REQUEST_SQL} SELECT COUNT(*) AS rows, CAST(4 AS BIGINT) AS batches, true AS replay_changed_nothing FROM cur",
)
def stream_idempotent(spark, sf):
    """Three batches, then the whole input once more by a new query with its own checkpoint. That
    is a fourth batch, not a replay, and the upsert leaves the same state."""
    root = fresh_dir(spark, "idempotent")
    sink = request_sink(spark, root)
    feed_slices(requests(spark, sf), root, "event_id", lambda: start_requests(spark, root, sink))
    before = fresh_dir(spark, "idempotent_before")
    sink.current().write.parquet(before)
    runners.await_all([start_requests(spark, root, sink, "checkpoint_replay")])
    changed = not sink.current().exceptAll(spark.read.parquet(before)).isEmpty()
    counts = sink.current().agg(F.count("*").alias("rows"))
    batches = sink.log.read().count()
    return counts.withColumns({"batches": F.lit(batches).cast("bigint"), "replay_changed_nothing": F.lit(not changed)})


@query("stream_apply_delta", f"WITH {VERSION_SQL} SELECT o_orderstatus, {sql_total('o_totalprice')} AS amount, COUNT(*) AS n FROM v1 GROUP BY 1")
def stream_apply_delta(spark, sf):
    """A change feed as a stream into a stored aggregate."""
    root = fresh_dir(spark, "delta")
    feed = stored(order_feed(spark, sf), "order_feed")
    sink = DeltaSink(spark, f"{root}/sink", feed.select("o_orderstatus").schema, money("o_totalprice"))

    def start():
        return runners.run_batches(runners.table_stream(spark, f"{root}/landing", feed.schema), sink, f"{root}/checkpoint")

    feed_slices(feed, root, "o_orderkey", start)
    v0, _ = order_versions(spark, sf)
    moved = sink.applied_to(by_status(v0), {"amount": "delta", "n": "row_delta"})
    return moved.withColumn("amount", F.col("amount").cast("double"))


# ---- layers and restarts ----------------------------------------------------------------------------

LAYER_SQL = """b AS (SELECT event_id, user_id, CASE WHEN event_id % 30 = 4 THEN NULL ELSE upper(event_type) END AS event_type, CASE WHEN event_id % 50 = 9 THEN -1.0 ELSE value END AS value FROM events),
  s AS (SELECT * FROM b WHERE event_type IS NOT NULL AND value >= 0)"""


def event_layers(spark, root):
    """Raw events, clean events with their rejects, totals of every user and type."""
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    totals = GroupSink(spark, f"{root}/totals", spark.createDataFrame([], "user_id bigint, event_type string, events bigint, amount decimal(38,2)").schema, ["user_id", "event_type"])

    def clean(bronze):
        return bronze.withColumn("event_type", F.upper("event_type"))

    def by_user(silver):
        return silver.groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.sum(money("value")).cast("decimal(38,2)").alias("amount"))

    rules = [dq.Rule("type", F.col("event_type").isNull()), dq.Rule("value", F.col("value") < 0), dq.Rule("large", F.col("value") > 100, severity="warning")]
    layers = [
        Layer("totals", ["silver"], by_user, sink=totals, mode="update"),
        Layer("silver", ["bronze"], clean, rules),
        Layer("bronze", ["landing"], lambda s: s),
    ]
    return StreamLayers(spark, root, {"landing": lambda s: runners.table_stream(s, f"{root}/landing", schema)}, layers), totals


@query(
    "stream_layers",
    f"""WITH {LAYER_SQL} SELECT 'total' AS layer, user_id, event_type, COUNT(*) AS events, {sql_total('value')} AS amount FROM s GROUP BY 2, 3
    UNION ALL SELECT 'bronze', NULL, NULL, COUNT(*), NULL FROM b UNION ALL SELECT 'silver', NULL, NULL, COUNT(*), NULL FROM s
    UNION ALL SELECT 'silver_rejected', NULL, NULL, COUNT(*), NULL FROM b WHERE NOT (event_type IS NOT NULL AND value >= 0)""",
)
def stream_layers(spark, sf):
    """Three chained layers, brought up to date after each of two deliveries by new objects."""
    root = fresh_dir(spark, "layers")
    k = F.col("event_id")
    events = event_rows(spark, sf).select(
        k, "user_id", F.when(k % 30 != 4, F.col("event_type")).alias("event_type"), F.when(k % 50 == 9, F.lit(-1.0)).otherwise(F.col("value")).alias("value")
    )
    for part in range(2):
        stage(events, f"{root}/landing", "event_id", slices=2, only=range(part, part + 1))
        layers, totals = event_layers(spark, root)
        layers.run()
    amounts = totals.current().select(F.lit("total").alias("layer"), "user_id", "event_type", "events", F.col("amount").cast("double").alias("amount"))
    counts = layers.counts().select("layer", F.col("rows").alias("events"))
    return amounts.unionByName(counts, allowMissingColumns=True)


@query(
    "stream_restart",
    """SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 1 THEN value END AS value, CAST(1 AS INTEGER) AS restarts FROM events""",
)
def stream_restart(spark, sf):
    """Files with a new column arrive while the stream runs: one restart, and no row is lost or doubled."""
    root = fresh_dir(spark, "restart")
    events = event_rows(spark, sf)
    old = events.where("event_id % 2 = 0").select("event_id", "user_id", "event_type")
    old.repartition(2).write.mode("append").parquet(f"{root}/landing")
    out = GrowingTable(spark, f"{root}/out", ["batch"])
    landed = []

    def process(batch, batch_id):
        out.append(batch.withColumn("batch", F.lit(batch_id)), overwrite_partitions=True)

    def reader():
        stream = runners.evolving_stream(spark, f"{root}/landing", maxFilesPerTrigger=1)
        if not landed:  # the producer changes its schema after the reader has looked
            landed.append(events.where("event_id % 2 = 1").drop("ts").repartition(1).write.mode("append").parquet(f"{root}/landing"))
        return stream

    restarts = runners.run_evolving(spark, f"{root}/landing", process, f"{root}/checkpoint", reader=reader)
    return out.read().drop("batch").withColumn("restarts", F.lit(restarts))
