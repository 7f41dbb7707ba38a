"""Aggregations: profiles, salted two-stage sums, exact quantiles, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laketide.operators.joins import broadcast_if_small, join_null_safe
from laketide.sources.writers import stored

#: Narrowing of exact quantiles: cells of a sketch, rows counted by value at the end, scans after which no sketch is asked.
CELLS = 512
FINAL_ROWS = 100_000
MOST_SCANS = 8


def unpivot_row(one_row: DataFrame, entries: Sequence[tuple[dict, dict]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry, inside Spark.

    Each entry is ``(constants, {output column: aggregate column})``.
    """
    structs = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in constants.items()],
            *[F.col(source).alias(out) for out, source in measures.items()],
        )
        for constants, measures in entries
    ]
    return one_row.select(F.inline(F.array(*structs)))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs of every column from one pass, one output row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def salt_of(*columns: str, salts: int = 16) -> Column:
    """Salt from a hash of the row, so a task that runs again gives the same salt."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts))


def salted_sums(
    df: DataFrame, keys: Sequence[str], salt_by: Sequence[str], sums: Mapping[str, Column], salts: int = 16
) -> DataFrame:
    """Sum by (key, salt), then by key. The first stage spreads a hot key over ``salts``
    tasks; the second sees at most ``salts`` rows per key."""
    staged = df.withColumn("__salt", salt_of(*salt_by, salts=salts)).groupBy(*keys, "__salt")
    partial = staged.agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return partial.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def group_skew(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).count()
    stats = sizes.agg(
        F.count("*").alias("groups"), F.max("count").alias("largest"), F.sum("count").alias("rows")
    )
    average = F.col("rows").cast("double") / F.col("groups")
    return stats.select(
        "groups", "largest", average.alias("average"), (F.col("largest") / average).alias("skew_ratio")
    )


def rows_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count("*").alias("rows"))


def profile(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """count / mean / stddev / min / max per column, from one pass."""
    aggs: list[Column] = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.round(F.avg(x), decimals).alias(f"mean_{c}"),
            F.round(F.stddev_samp(x), decimals).alias(f"sd_{c}"),
            F.min(x).alias(f"lo_{c}"),
            F.max(x).alias(f"hi_{c}"),
        ]
    return unpivot_row(
        df.agg(*aggs),
        [
            ({"column": c}, {"n": f"n_{c}", "mean": f"mean_{c}", "stddev": f"sd_{c}", "min": f"lo_{c}", "max": f"hi_{c}"})
            for c in columns
        ],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), cells: int = CELLS, limit: int = FINAL_ROWS
) -> DataFrame:
    """Exact interpolated quantiles by narrowing: no column is stored and no group is gathered.

    Every wanted rank has an open interval of values that holds it. A scan counts, per group, the
    rows below, at the ends of and inside each interval and sketches the inside as ``cells`` cells of
    about equal rows; the cell of the rank and its neighbours are the next interval. A rank on an end
    is answered. So each scan leaves about 3 / cells of the rows: three scans up to a billion rows.
    A sketch only proposes; if its interval misses the rank, the counts say so and the other side
    is taken. Intervals of at most ``limit`` rows are then counted by value in one last scan. NaN
    is the largest value, as in Spark's order. What is stored is one row per group.
    Columns: keys, ``q0``, ``q1``, ... in the order of ``probabilities``.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    points = F.array(*[F.lit(i / cells) for i in range(cells + 1)])
    ranks = range(2 * len(probabilities))  # floor and ceiling of every position

    def attach(state: DataFrame) -> DataFrame:
        if keys:
            return join_null_safe(present, broadcast_if_small(state), keys)
        # one row, carried as literals of the driver, not as a cross join
        row = state.first()
        return present.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in state.schema.fields})

    def inside(i: int) -> Column:
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        return F.coalesce(v > lo, F.lit(True)) & F.coalesce(v < hi, F.lit(True))

    def narrowed(rank: Column, held: Column, grid: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        """The cell of the ``rank``-th of ``held`` rows and its neighbours; an outer end stays."""
        cell = F.floor(rank * cells / F.greatest(held, F.lit(1))).cast("int")
        return F.when(cell >= 1, F.get(grid, cell - 1)).otherwise(lo), F.when(cell + 2 <= cells, F.get(grid, cell + 2)).otherwise(hi)

    nothing = F.lit(None).cast("double")
    first = present.groupBy(*keys).agg(F.count("*").alias("__size"), F.percentile_approx(v, points, F.lit(16 * cells)).alias("__grid"))
    columns = [*keys, "__size"]
    small = F.col("__size") <= limit
    for i in ranks:
        position = (F.col("__size") - 1) * F.lit(float(probabilities[i // 2]))
        rank = (F.ceil(position) if i % 2 else F.floor(position)).cast("long")
        lo, hi = narrowed(rank, F.col("__size"), F.col("__grid"), nothing, nothing)
        columns += [rank.alias(f"__r{i}"), F.when(~small, lo).alias(f"__lo{i}"), F.when(~small, hi).alias(f"__hi{i}"), nothing.alias(f"__x{i}"), F.when(small, F.lit(0)).cast("long").alias(f"__b{i}")]
    state = stored(first.select(*columns), "quantile_intervals")

    # a rank is open while it has neither a value nor a count of the rows before its interval
    still = [F.col(f"__x{i}").isNull() & F.col(f"__b{i}").isNull() for i in ranks]
    scans = 1
    while not state.where(reduce(or_, still)).isEmpty():
        aggs = []
        for i in ranks:
            lo, hi, wanted = F.col(f"__lo{i}"), F.col(f"__hi{i}"), still[i]
            aggs += [F.count_if(wanted & test).alias(f"__{n}{i}") for n, test in (("lt", v < lo), ("at", v == lo), ("in", inside(i)), ("end", v == hi))]
            aggs.append(F.percentile_approx(F.when(wanted & inside(i), v), points, F.lit(16 * cells)).alias(f"__g{i}"))
            aggs += [F.first(c).alias(c) for c in (f"__r{i}", f"__lo{i}", f"__hi{i}", f"__x{i}", f"__b{i}")]
        counted = attach(state).groupBy(*keys).agg(F.first("__size").alias("__size"), *aggs)
        columns = [*keys, "__size"]
        for i in ranks:
            r, lo, hi, lt, at, within, end = (F.col(f"__{n}{i}") for n in ("r", "lo", "hi", "lt", "at", "in", "end"))
            before = lt + at
            held = (r >= before) & (r < before + within)
            # after many scans an interval is taken as it is: its values are counted, however many rows it has
            ready = held & ((within <= limit) | F.lit(scans >= MOST_SCANS))
            next_lo, next_hi = narrowed(r - before, within, F.col(f"__g{i}"), lo, hi)
            x = F.when((r >= lt) & (r < before), lo).when((r >= before + within) & (r < before + within + end), hi)
            low = F.when(ready, lo).when(held, next_lo).when(r < lt, nothing).otherwise(hi)
            high = F.when(ready, hi).when(held, next_hi).when(r < lt, lo)
            columns.append(r)
            for name, new in (("lo", low), ("hi", high), ("x", x), ("b", F.when(ready, before))):
                columns.append(F.when(still[i], new).otherwise(F.col(f"__{name}{i}")).alias(f"__{name}{i}"))
        state = stored(counted.select(*columns), "quantile_intervals")
        scans += 1

    # ranks of one interval share its values, counted once
    lows, highs = [F.col(f"__lo{i}").alias("__lo") for i in ranks], [F.col(f"__hi{i}").alias("__hi") for i in ranks]
    unanswered = [F.col(f"__x{i}").isNull() for i in ranks]
    mine = F.array(*[F.when(unanswered[i] & inside(i), F.struct(lows[i], highs[i])) for i in ranks])
    span = [*keys, "__lo", "__hi"]
    held = attach(state).where(reduce(or_, [unanswered[i] & inside(i) for i in ranks]))
    values = held.select(*keys, v, F.inline(F.array_distinct(F.array_compact(mine)))).groupBy(*span, "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*span).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = F.array(*[F.when(unanswered[i], F.struct(F.lit(i).alias("i"), (F.col(f"__r{i}") - F.col(f"__b{i}")).alias("__r"), lows[i], highs[i])) for i in ranks])
    asked = state.select(*keys, F.inline(F.array_compact(asked)))
    answers = join_null_safe(values.withColumn("__upto", upto), broadcast_if_small(asked), span)
    answers = answers.where((F.col("__upto") > F.col("__r")) & (F.col("__upto") - F.col("__n") <= F.col("__r")))
    answers = answers.select(*keys, "i", F.col("__v").alias("x"))
    # ranks answered on the way come from the state; one row per group and rank
    known = state.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__x{i}").alias("x")) for i in ranks])))
    sizes = state.select(*keys, F.lit(-1).alias("i"), F.col("__size").cast("double").alias("x"))
    found = known.unionAll(answers).unionAll(sizes).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"__x{i}") for i in ranks], F.max(F.when(F.col("i") == -1, F.col("x"))).alias("__size"))
    out = []
    for i, p in enumerate(probabilities):
        position = (F.col("__size") - 1) * F.lit(float(p))
        low, high = F.col(f"__x{2 * i}"), F.col(f"__x{2 * i + 1}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(f"q{i}"))
    return found.select(*keys, *out)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str, tolerance: float = 0.01) -> DataFrame:
    """Compare one measure of two aggregates by key; a key missing on one side does not match."""
    a = left.select(*keys, F.col(measure).alias("left_value"))
    b = right.select(*keys, F.col(measure).alias("right_value"))
    both = a.join(b, list(keys), "full_outer")
    close = F.abs(F.col("left_value") - F.col("right_value")) < tolerance
    return both.withColumn("matches", F.coalesce(close, F.lit(False)))
