"""Micro-batch sinks with exactly-once results on plain Parquet.

A sink numbers its batches. Each writes its own ``batch=<number>`` folder with overwrite and is
logged afterwards, with the id of the streaming query and the query's own batch number. A
replay of a batch that died gets the same number and replaces its folder; a batch that its
query has logged is skipped. A query with a new checkpoint has a new id and counts from 0
again: its batches are new work, which an upsert takes without harm if they bring known rows.
Current rows are the newest row per key, so a batch costs as much as the batch, not as the
table; ``compact`` folds old batches into one base. State that batches look into is kept in
buckets of its keys, and a look reads only the buckets of the keys it is about.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.operators import changes
from laketide.operators import quality as dq
from laketide.operators.windows import latest_per_key
from laketide.sources.writers import exists, stored

LOG_SCHEMA = "batch_id bigint, rows_in bigint, rows_good bigint, rows_quarantined bigint, query_id string, number bigint"


def query_of(batch: DataFrame) -> str:
    """The id of the streaming query that runs the current batch; empty outside of one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def observed(seen: Observation, written: Callable[[], DataFrame]) -> int:
    """The rows that ``seen`` counted while a batch was written. The optimizer may replace an empty
    batch, observation and all, by an empty table; then the written rows are counted."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return written().count()


BUCKET = "__bucket"


class Buckets:
    """Rows dealt to folders by a hash of some columns, so a read can leave out most of them."""

    def __init__(self, keys: Sequence[str], number: int):
        self.keys, self.number = list(keys), number

    def column(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.number)).cast("int")

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` belong to: at most ``number`` values come to the driver."""
        return sorted(r[0] for r in rows.select(self.column()).distinct().collect())

    def write(self, df: DataFrame, path: str) -> None:
        dealt = df.withColumn(BUCKET, self.column()).hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path)


class BatchFolder:
    """Numbered batches of one schema below ``path``, in buckets if ``buckets`` are given."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: Buckets | None = None):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def write(self, df: DataFrame, batch_id: int) -> None:
        path = f"{self.path}/batch={batch_id}"
        if self.buckets:
            self.buckets.write(df, path)
        else:
            df.write.mode("overwrite").parquet(path)

    def read(self, upto: int | None, after: int = -1, only: Sequence[int] | None = None) -> DataFrame:
        """Batches ``after < id <= upto`` with their number in ``batch``; of the buckets ``only``."""
        kept = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if upto is None or upto <= after:
            return self.spark.createDataFrame([], kept)
        schema = T.StructType([*kept.fields, T.StructField(BUCKET, T.IntegerType())]) if self.buckets else kept
        rows = self.spark.read.option("basePath", self.path).schema(schema).parquet(f"{self.path}/batch=*")
        rows = rows.where((F.col("batch") <= upto) & (F.col("batch") > after))
        if only is not None and self.buckets:
            rows = rows.where(F.col(BUCKET).isin(list(only)))
        return rows.select(*kept.names)


class BatchLog:
    """Finished batches of one sink. Only the sink's own stream writes to it, so the writer
    remembers its last entry; readers always look it up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._seen: dict[str, int] | None = None
        self._number = -1

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def last(self) -> int | None:
        """The number of the last logged batch."""
        return self.read().agg(F.max("number")).first()[0]

    def begin(self, batch: DataFrame, batch_id: int) -> int | None:
        """The number for a batch, or None if its query has logged it."""
        if self._seen is None:
            # one row for each query that ever fed this sink
            self._seen = {r["query_id"]: r["b"] for r in self.read().groupBy("query_id").agg(F.max("batch_id").alias("b")).collect()}
            last = self.last()
            self._number = -1 if last is None else last
        return None if batch_id <= self._seen.get(query_of(batch), -1) else self._number + 1

    def add(self, batch: DataFrame, batch_id: int, number: int, rows_in: int, good: int, bad: int) -> None:
        row = self.spark.createDataFrame([(batch_id, rows_in, good, bad, query_of(batch), number)], LOG_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path)
        self._seen[query_of(batch)] = batch_id
        self._number = number


class KeyedState:
    """One row per key over all logged batches; ``compact`` bounds what a read has to touch. With
    ``buckets`` the rows lie in folders by a hash of the keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 0):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.order: list[str] = []
        self.buckets = Buckets(self.keys, buckets) if buckets else None
        self.rows = BatchFolder(spark, f"{self.path}/rows", schema, self.buckets)
        self.log = BatchLog(spark, f"{self.path}/log")

    def _base(self) -> tuple[str | None, int]:
        """The folder of the newest compacted state and the last batch it holds."""
        if not exists(self.spark, f"{self.path}/bases"):
            return None, -1
        upto = self.spark.read.parquet(f"{self.path}/bases").agg(F.max("upto")).first()[0]
        return f"{self.path}/base/upto={upto}", upto

    def entries(self, upto: int | None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of the base and of all later batches up to ``upto``, with ``batch``."""
        base, held = self._base()
        rows = self.rows.read(upto, after=held, only=only)
        if base is None:
            return rows
        schema = self.rows.schema
        if self.buckets:
            schema = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        old = self.spark.read.schema(schema).parquet(base)
        if self.buckets and only is not None:
            old = old.where(F.col(BUCKET).isin(list(only)))
        return old.select(*self.rows.schema.names, F.lit(held).cast("bigint").alias("batch")).unionByName(rows)

    def folded(self, entries: DataFrame) -> DataFrame:
        """What ``entries`` come to: the newest row of every key, by ``order``, then by batch."""
        return latest_per_key(entries, self.keys, [*self.order, "batch"]).drop("batch")

    def current(self, upto: int | None = None) -> DataFrame:
        """The state up to the last logged (or a given) batch."""
        return self.folded(self.entries(self.log.last() if upto is None else upto))

    def current_of(self, keys: DataFrame, upto: int) -> DataFrame:
        """The state of some keys (a frame with the key columns). Only their buckets are read, and
        other rows of these are left out before anything is folded."""
        only = self.buckets.of(keys) if self.buckets else None
        wanted = keys.select(*[F.col(k).alias(f"__w_{k}") for k in self.keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in self.keys])
        return self.folded(self.entries(upto, only).join(wanted, same, "left_semi"))

    def compact(self, upto: int | None = None) -> None:
        """Write the current state as a new base; the batches in it are no longer read."""
        last = self.log.last() if upto is None else upto
        if last is None:
            return
        path = f"{self.path}/base/upto={last}"
        if self.buckets:
            self.buckets.write(self.current(last), path)
        else:
            self.current(last).write.mode("overwrite").parquet(path)
        mark = self.spark.createDataFrame([(last,)], "upto bigint")
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/bases")


class UpsertSink(KeyedState):
    """Quality split, quarantine, in-batch dedup, upsert, optional publishing, batch log.

    With ``newest_wins`` a late row does not replace a newer one of an earlier batch; without it
    the last batch wins, as in a plain upsert. ``gold`` takes the old and new images of the rows
    that a batch changed, so it is kept up to date without reading the state; ``publish`` gets the
    whole state.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        newest_by: Sequence[str],
        rules: Sequence[dq.Rule] = (),
        publish: Callable[[DataFrame, int], None] | None = None,
        newest_wins: bool = True,
        gold: GroupTotals | None = None,
        buckets: int = 0,
    ):
        super().__init__(spark, path, schema, keys, buckets)
        self.gold = gold
        self.order = list(newest_by) if newest_wins else []
        self.newest_by, self.rules, self.publish = list(newest_by), list(rules), publish
        self.quarantine = BatchFolder(spark, f"{self.path}/quarantine", schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        number = self.log.begin(batch, batch_id)
        if number is None:
            return
        marked = batch.withColumn("__bad", dq.bad_mask(self.rules, "fail")).persist()
        try:
            counts = marked.agg(F.count("*").alias("n"), F.count_if("__bad").alias("bad")).first()
            good = marked.where("NOT __bad").drop("__bad")
            if counts["bad"]:
                self.quarantine.write(marked.where("__bad").drop("__bad"), number)
            self.rows.write(latest_per_key(good, self.keys, self.newest_by), number)
            if self.gold is not None:
                self.gold.fold(self.images(number), number)
            if self.publish is not None:
                self.publish(self.current(number), number)
            self.log.add(batch, batch_id, number, counts["n"], counts["n"] - counts["bad"], counts["bad"])
        finally:
            marked.unpersist()


    def images(self, number: int) -> DataFrame:
        """What a written batch changes: a row's old image with ``sign`` -1, its new one with 1. A row
        that is late and changes nothing has none."""
        new = self.rows.read(number, after=number - 1)
        old = self.current_of(new, number - 1)
        pairs = old.select(F.struct(*self.rows.schema.names).alias("o")).join(
            new.select(F.struct(*self.rows.schema.names).alias("n")),
            reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]),
            "right",
        )
        if self.order:
            place = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in self.order])
            pairs = pairs.where(F.col("o").isNull() | (place("n") >= place("o")))

        def image(side: str, sign: int) -> Column:
            return F.struct(F.col(side).alias("row"), F.lit(sign).alias("sign"))

        both = F.when(F.col("o").isNull(), F.array(image("n", 1))).otherwise(F.array(image("o", -1), image("n", 1)))
        return pairs.select(F.explode(both).alias("i")).select("i.row.*", "i.sign")


class GroupSink(KeyedState):
    """Results of a streaming aggregate in update mode: each batch brings the groups that
    changed, the newest row of a group counts."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        number = self.log.begin(batch, batch_id)
        if number is None:
            return
        seen = Observation()
        self.rows.write(batch.observe(seen, F.count(F.lit(1)).alias("n")), number)
        n = observed(seen, lambda: self.rows.read(number, after=number - 1))
        self.log.add(batch, batch_id, number, n, n, 0)


class DeltaSink:
    """Change rows into a stored aggregate: each batch is reduced to its net change; sums are
    associative, so the aggregate is the start value plus all net changes."""

    def __init__(self, spark: SparkSession, path: str, key_schema: T.StructType, measure: Column, delta_type: str = "decimal(38,2)"):
        self.keys, self.measure, self.delta_type = key_schema.names, measure, delta_type
        delta = spark.createDataFrame([], f"delta {delta_type}, row_delta bigint").schema
        self.deltas = BatchFolder(spark, f"{path}/deltas", T.StructType([*key_schema.fields, *delta.fields]))
        self.log = BatchLog(spark, f"{path}/log")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        number = self.log.begin(batch, batch_id)
        if number is None:
            return
        seen = Observation()
        net = changes.net_change(batch.observe(seen, F.count(F.lit(1)).alias("n")), self.keys, self.measure)
        self.deltas.write(net.withColumn("delta", F.col("delta").cast(self.delta_type)), number)
        n = observed(seen, lambda: self.deltas.read(number, after=number - 1))
        self.log.add(batch, batch_id, number, n, n, 0)

    def applied_to(self, aggregate: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
        """The aggregate after all logged batches; ``pairs`` maps its columns to ``delta`` and
        ``row_delta``."""
        net = self.deltas.read(self.log.last()).groupBy(*self.keys)
        moved = net.agg(*[F.sum(d).alias(d) for d in pairs.values()])
        return changes.apply_delta(aggregate, moved, self.keys, pairs)


class NetCounts(KeyedState):
    """How often a value stands in a group, as a sum of signed counts over batches."""

    def folded(self, entries: DataFrame) -> DataFrame:
        columns = [c for c in self.rows.schema.names if c != "n"]
        return entries.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")


class GroupTotals:
    """Totals per group of a state that changes, kept by retraction.

    A batch brings signed images of the rows it changed. Counts and sums take them as they are.
    For ``extremes`` the counts of each group's values are kept beside; the minimum and maximum of a
    group follow the values that came, and are looked up in those counts only if the stored
    extreme itself went, reading the buckets of such groups. So a batch costs what it changes.

    ``groups``, ``sums`` and ``extremes`` map result columns to expressions on the rows; sums are
    exact if their expressions are decimals. A repeated batch number replaces its earlier fold.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        rows: T.StructType,
        groups: Mapping[str, Column],
        sums: Mapping[str, Column],
        extremes: Mapping[str, Column] | None = None,
        buckets: int = 16,
    ):
        self.groups, self.sums, self.extremes = dict(groups), dict(sums), dict(extremes or {})
        self.names = list(groups)
        empty = self._measured(spark.createDataFrame([], T.StructType([*rows.fields, T.StructField("sign", T.IntegerType())])))
        kinds = {f.name: f.dataType for f in empty.schema.fields}
        fields = [T.StructField(g, kinds[g]) for g in self.names] + [T.StructField("rows", T.LongType())]
        for s in self.sums:
            total = T.DecimalType(38, kinds[s].scale) if isinstance(kinds[s], T.DecimalType) else empty.agg(F.sum(s).alias(s)).schema[s].dataType
            fields += [T.StructField(s, total), T.StructField(f"{s}_n", T.LongType())]
        for e in self.extremes:
            fields += [T.StructField(f"{e}_min", kinds[e]), T.StructField(f"{e}_max", kinds[e])]
        self.state = KeyedState(spark, f"{path}/totals", T.StructType(fields), self.names, buckets)
        self.values = {}
        for e in self.extremes:
            schema = T.StructType([*[T.StructField(g, kinds[g]) for g in self.names], T.StructField("value", kinds[e]), T.StructField("n", T.LongType())])
            self.values[e] = NetCounts(spark, f"{path}/values_{e}", schema, self.names, buckets)

    def _measured(self, images: DataFrame) -> DataFrame:
        columns = {**self.groups, **self.sums, **self.extremes}
        return images.select(*[c.alias(n) for n, c in columns.items()], "sign")

    def _same(self, prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{prefix}{g}")) for g in self.names])

    def _beside(self, left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``left`` with some columns of the same group in ``right``."""
        other = right.select(*[F.col(g).alias(f"__r_{g}") for g in self.names], *columns)
        return left.join(other, self._same("__r_"), "left").drop(*[f"__r_{g}" for g in self.names])

    def fold(self, images: DataFrame, number: int) -> None:
        """Take the signed images of batch ``number``."""
        rows = stored(self._measured(images), "images")  # as many as the batch changed; read once per measure, and for the touched groups
        parts = [F.sum("sign").cast("bigint").alias("rows")]
        for s in self.sums:
            parts += [F.sum(F.col(s) * F.col("sign")).alias(s), F.coalesce(F.sum(F.when(F.col(s).isNotNull(), F.col("sign"))), F.lit(0)).cast("bigint").alias(f"{s}_n")]
        moved = rows.groupBy(*self.names).agg(*parts)
        touched = rows.select(*self.names).distinct()
        before = self.state.current_of(touched, number - 1)
        new = self._beside(moved, before.select(*self.names, *[F.col(c).alias(f"__o_{c}") for c in self.state.rows.schema.names if c not in self.names]), [f"__o_{c}" for c in self.state.rows.schema.names if c not in self.names])
        kinds = {f.name: f.dataType for f in self.state.rows.schema.fields}
        sums = ["rows", *[c for s in self.sums for c in (s, f"{s}_n")]]
        for c in sums:
            new = new.withColumn(c, (F.coalesce(F.col(f"__o_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).cast(kinds[c]))
        for e in self.extremes:
            new = self._with_extremes(new, rows, e, number)
        self.state.rows.write(new.select(*self.state.rows.schema.names), number)

    def _with_extremes(self, new: DataFrame, rows: DataFrame, e: str, number: int) -> DataFrame:
        values = self.values[e]
        net = rows.where(F.col(e).isNotNull()).groupBy(*self.names, F.col(e).alias("value")).agg(F.sum("sign").cast("bigint").alias("n")).where("n <> 0")
        values.rows.write(net, number)
        net = values.rows.read(number, after=number - 1)
        came, went = F.when(F.col("n") > 0, F.col("value")), F.when(F.col("n") < 0, F.col("value"))
        ends = net.groupBy(*self.names).agg(F.min(came).alias("__came_min"), F.max(came).alias("__came_max"), F.min(went).alias("__went_min"), F.max(went).alias("__went_max"))
        new = self._beside(new, ends, ["__came_min", "__came_max", "__went_min", "__went_max"])
        gone = F.coalesce((F.col("__went_min") <= F.col(f"__o_{e}_min")) | (F.col("__went_max") >= F.col(f"__o_{e}_max")), F.lit(False))
        new = stored(new.withColumn("__gone", gone), "totals")  # one row per group of the batch
        lost = new.where("__gone").select(*self.names)
        left = values.current_of(lost, number).where("n > 0").groupBy(*self.names).agg(F.min("value").alias("__left_min"), F.max("value").alias("__left_max"))
        new = self._beside(new, left, ["__left_min", "__left_max"])
        for end, pick in (("min", F.least), ("max", F.greatest)):
            kept = pick(F.col(f"__o_{e}_{end}"), F.col(f"__came_{end}"))
            new = new.withColumn(f"{e}_{end}", F.when(F.col("__gone"), F.col(f"__left_{end}")).otherwise(kept))
        return new.drop("__gone", "__left_min", "__left_max", "__came_min", "__came_max", "__went_min", "__went_max")

    def current(self, upto: int | None) -> DataFrame:
        """The totals after batch ``upto``; groups without rows are gone."""
        return self.state.current(-1 if upto is None else upto).where(F.col("rows") > 0)

    def compact(self, upto: int) -> None:
        """Fold all batches up to ``upto`` into one base each."""
        for part in (self.state, *self.values.values()):
            part.compact(upto)
