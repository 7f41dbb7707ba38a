"""Join helpers. Plain joins are left to Catalyst, which broadcasts a side only when its
statistics (or, with adaptive execution, its measured size) are below the threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Size of a row's values: text by its length, nested values by their JSON text."""
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measured, not estimated: one aggregate, so one small row per task is shuffled."""
    size = df.agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring rows and bytes. A larger side is returned
    unhinted, for a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def enrich(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str] | str]]) -> DataFrame:
    """Left-join several dimensions; the fact keeps its row count when the keys are unique."""
    return reduce(lambda df, d: df.join(d[0], on=d[1], how="left"), dimensions, fact)


def full_outer(frames: Sequence[DataFrame], on: Sequence[str] | str, fill: Mapping | None = None) -> DataFrame:
    """Chain of full outer joins on one coalesced key, missing measures filled."""
    joined = reduce(lambda a, b: a.join(b, on=on, how="full_outer"), frames)
    return joined.fillna(dict(fill)) if fill else joined


def side_by_side(frames: Sequence[DataFrame], on: Sequence[str] | str, fill: Mapping | None = None) -> DataFrame:
    """Full outer join of frames that hold one row per key and no measure in common.

    The frames are stacked and grouped once. A chain of full outer joins gives the same rows
    but shuffles again after every join, because each has a new, coalesced key. Rows with a
    NULL key, which never match in a join, become one row here.
    """
    keys = [on] if isinstance(on, str) else list(on)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    measures = [c for c in stacked.columns if c not in keys]
    joined = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures])
    return joined.fillna(dict(fill)) if fill else joined


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a NULL key counts as an orphan, as in an anti join."""
    keys = parent.select(F.col(parent_key).alias("__parent_key"))
    return child.join(keys, F.col(child_key) == F.col("__parent_key"), "left_anti")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``column NOT IN (SELECT other_column ...)`` with SQL's NULL rules, as a shuffled anti
    join. Spark runs the SQL form by broadcasting the subquery, whatever its size."""
    values = other.select(F.col(other_column).alias("__value"))
    if values.isEmpty():
        return df
    if not values.where("__value IS NULL").isEmpty():
        return df.where(F.lit(False))
    return df.where(F.col(column).isNotNull()).join(values, F.col(column) == F.col("__value"), "left_anti")


def changed(
    source: DataFrame, target: DataFrame, keys: Sequence[str], compare: Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Source rows whose compared columns differ from the target row of the same key. With
    ``null_safe=False`` a comparison with NULL never reports a change."""

    def differs(c: str) -> Column:
        if null_safe:
            return ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
        return F.col(f"s.{c}") != F.col(f"t.{c}")

    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    pairs = source.alias("s").join(target.alias("t"), reduce(lambda a, b: a & b, on))
    return pairs.where(reduce(lambda a, b: a | b, [differs(c) for c in compare])).select("s.*")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join where a NULL key equals a NULL key; only the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])
