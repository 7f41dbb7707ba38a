"""Ordered operators that stay balanced when one key holds much of the table.

A plain window sends all rows of a key to one task. ``prefix_sums`` and ``bounded_frame``
therefore look for hot keys first. Without one they are a plain window. Rows of a hot key are
windowed inside (key, chunk), and only one small row per (key, chunk) is ordered per key;
rows of other keys form a single chunk. ``chunk`` is any column that never decreases along
the order, such as the ordering minute, or a struct of day and id range.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from laketide.functions.scalars import bucket_by_bounds
from laketide.operators.joins import join_null_safe
from laketide.sources.writers import stored

Chunk = Column | Callable[[], Column]

HOT_ROWS = 5_000_000
BLOCK_ROWS = 1_000_000


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``newest_by``, ties broken by the remaining columns.

    An aggregate instead of ``row_number() = 1``: it is combined before the shuffle, so a key
    with very many copies sends one row per task. All columns must be orderable (no maps).
    """
    rest = [c for c in df.columns if c not in keys and c not in newest_by]
    ranked = F.max(F.struct(*newest_by, *rest)).alias("__row")
    picked = df.groupBy(*keys).agg(ranked)
    return picked.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, method: str = "row_number"
) -> DataFrame:
    """Rows ranked <= k. Spark cuts each input partition to its own top k before the shuffle
    (``WindowGroupLimit`` in the plan), so group size does not matter."""
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rnk", rank().over(w)).where(F.col("rnk") <= k)


def top_n_ranked(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Global top n with its rank. The sort and limit run first (each task keeps n rows), so
    the unpartitioned numbering only ever sees n rows."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None. Reads the key columns once; at most
    ``rows / hot_rows`` keys can be hot, and they are stored, so that the check and the later
    join do not count twice."""
    counts = df.groupBy(*keys).count().where(F.col("count") > hot_rows)
    found = stored(counts.select(*keys, F.lit(True).alias("__hot")), "hot_keys")
    return None if found.isEmpty() else found


def chunked(df: DataFrame, keys: Sequence[str], chunk: Chunk, hot_rows: int) -> DataFrame | None:
    """``df`` with ``__chunk`` filled for hot keys only, or None when no key is hot. Without
    keys the whole frame is one group."""
    if keys:
        hot = hot_keys(df, keys, hot_rows)
        if hot is None:
            return None
        marked = join_null_safe(df, hot, keys)
    else:
        if df.count() <= hot_rows:
            return None
        marked = df.withColumn("__hot", F.lit(True))
    pieces = chunk() if callable(chunk) else chunk
    return marked.withColumn("__chunk", F.when(F.col("__hot"), pieces)).drop("__hot")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str | Column],
    chunk: Chunk,
    inclusive: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running sums along ``order`` within ``keys``; exclusive ones leave the row itself out.

    Rows, columns and types are the same whether or not a key is hot. ``chunk`` follows the
    first ordering column, in its direction and with its place for NULLs.
    """
    keys = list(keys)
    return _running(df, chunked(df, keys, chunk, hot_rows), keys, order, sums, inclusive)


def _direction(order: Sequence[str | Column], column: str) -> Column:
    """``column`` ordered as the first column of ``order`` is."""
    first = order[0] if order else ""
    text = "" if isinstance(first, str) else str(first)
    down = bool(re.search(r"\bDESC\b", text))
    nulls_last = "NULLS LAST" in text
    kinds = {(False, False): F.asc_nulls_first, (False, True): F.asc_nulls_last, (True, False): F.desc_nulls_first, (True, True): F.desc_nulls_last}
    return kinds[down, nulls_last](column)


def _running(df: DataFrame, part: DataFrame | None, keys: list[str], order: Sequence[str | Column], sums: Mapping[str, str | Column], inclusive: bool) -> DataFrame:
    """``prefix_sums`` with the chunks of ``df`` already found (None: no hot key)."""
    last = Window.currentRow if inclusive else -1
    values = {n: F.expr(v) if isinstance(v, str) else v for n, v in sums.items()}
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    plain = df.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in values.items()})
    if part is None:
        return plain

    # one struct for all keys: comparable as a whole even where a key is NULL, and the join
    # below reuses the partitioning of the window above it
    part = part.withColumn("__key", F.struct(*keys) if keys else F.lit(0))
    per_chunk = part.groupBy("__key", "__chunk").agg(*[F.sum(v).alias(f"__s_{n}") for n, v in values.items()])
    before = Window.partitionBy("__key").orderBy(_direction(order, "__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        F.col("__key").alias("__carry_key"),
        F.col("__chunk").alias("__carry_chunk"),
        *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in values],
    )
    inside = Window.partitionBy("__key", "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = part.withColumns({f"__l_{n}": F.sum(v).over(inside) for n, v in values.items()})
    # a NULL chunk is a cold key's only one, or where a hot key's NULLs stand
    on = (F.col("__key") == F.col("__carry_key")) & F.col("__chunk").eqNullSafe(F.col("__carry_chunk"))
    joined = local.join(carry, on, "left")
    zero = F.lit(0)
    total = {n: (F.coalesce(f"__l_{n}", zero) + F.coalesce(f"__c_{n}", zero)).cast(plain.schema[n].dataType) for n in values}
    return joined.select(*[total[c].alias(c) if c in total else F.col(c) for c in plain.columns])


def bounded_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    chunk: Chunk,
    before: int = 0,
    after: int = 0,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` maps a name to a function of the ordered window (lag, lead, a moving
    aggregate). ``order`` must be total within a key. For a hot key the rows are numbered
    with ``prefix_sums`` and cut into blocks; each block also gets the few rows of its
    neighbours that the frame reaches, and gives them back after the window ran.
    """
    keys = list(keys)
    part = chunked(df, keys, chunk, hot_rows)
    if part is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: make(w) for n, make in columns.items()})

    block_rows = max(block_rows, before, after, 1)
    ones = {"__n": F.lit(1).cast("bigint")}
    numbered = _running(df, part, keys, order, ones, inclusive=False)
    home = F.floor(F.col("__n") / block_rows)
    at = F.col("__n") % block_rows
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= block_rows - before, home + 1),
            F.when((at < after) & (home > 0), home - 1),
        )
    )
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(targets))
    w = Window.partitionBy(*keys, "__block").orderBy("__n")
    framed = spread.withColumns({n: make(w) for n, make in columns.items()})
    return framed.where("__block = __home").drop("__n", "__home", "__block")


def range_chunks(df: DataFrame, c: str, n: int = 64) -> Column:
    """Split the values of a numeric column into about equal chunks.

    Only ``n - 1`` approximate quantiles come to the driver; results never depend on where
    the bounds lie, only the balance does."""
    bounds = df.approxQuantile(c, [i / n for i in range(1, n)], 0.5 / n)
    return bucket_by_bounds(F.col(c), sorted(set(bounds)))


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Partition-wide aggregates on every row: aggregate (combined before the shuffle), store,
    join back. From the stored size Catalyst knows when to broadcast, which leaves ``df``
    unshuffled; otherwise adaptive execution can split a hot group, a window it cannot."""
    grouped = stored(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), "group_stats")
    return join_null_safe(df, grouped, keys)


def strictly_past(
    df: DataFrame, keys: Sequence[str], at: str, sums: Mapping[str, Column], chunk: Chunk, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Totals over rows of the same key with a strictly smaller ``at`` (rows that share a time
    never see each other). Sums are first built, and stored, per (key, time)."""
    per_time = stored(df.groupBy(*keys, at).agg(*[F.sum(v).alias(f"__v_{n}") for n, v in sums.items()]), "per_time")
    past = prefix_sums(
        per_time, keys, [at], {n: F.col(f"__v_{n}") for n in sums}, chunk, inclusive=False, hot_rows=hot_rows
    )
    here = [*keys, at]
    return join_null_safe(df, past.select(*here, *sums), here)
