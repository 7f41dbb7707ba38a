"""Slowly changing dimensions, type 2. Both forms share one close-and-insert step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import row_fingerprint
from laketide.operators.changes import one_row_per_key, unmatched
from laketide.sources.writers import stored


def initial(rows: DataFrame, valid_from: Column) -> DataFrame:
    """First load: every row is the current version 1."""
    return rows.withColumns(
        {
            "version": F.lit(1),
            "valid_from": valid_from,
            "valid_to": F.lit(None).cast("timestamp_ntz"),
            "is_current": F.lit(True),
        }
    )


def _apply(dim: DataFrame, changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], differs: Column, at: Column, dedup_by: Sequence[str] | None) -> DataFrame:
    """``differs`` compares ``t.`` (current version) and ``s.`` (incoming row).

    Several changes for one key are refused unless ``dedup_by`` tells which is the newest. They
    are stored once, as the pairs and the new keys both read them.
    History is never joined: only current rows meet the changes, in one left join from the
    dimension side, so changes measured to be small are broadcast and the dimension is not
    shuffled.
    """
    changes = one_row_per_key(stored(changes, "scd_changes"), keys, dedup_by)
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    history, current = dim.where(~F.col("is_current")), dim.where(F.col("is_current"))
    pairs = current.alias("t").join(changes.select("*", F.lit(True).alias("__hit")).alias("s"), on, "left")
    moved = F.col("s.__hit").isNotNull() & F.coalesce(differs, F.lit(False))
    # A changed key yields its closed version and its next version; others yield themselves.
    closed = F.struct(
        *[
            (
                F.when(moved, at).otherwise(F.col("t.valid_to"))
                if c == "valid_to"
                else F.when(moved, F.lit(False)).otherwise(F.col("t.is_current"))
                if c == "is_current"
                else F.col(f"t.{c}")
            ).alias(c)
            for c in dim.columns
        ]
    )
    opened = F.struct(
        *[
            (
                F.col("t.version") + 1
                if c == "version"
                else at
                if c == "valid_from"
                else F.lit(None).cast(dim.schema[c].dataType)
                if c == "valid_to"
                else F.lit(True)
                if c == "is_current"
                else F.col(f"s.{c}").cast(dim.schema[c].dataType)
                if c in [*keys, *tracked]
                else F.col(f"t.{c}")
            ).alias(c)
            for c in dim.columns
        ]
    )
    versions = pairs.select(F.explode(F.when(moved, F.array(closed, opened)).otherwise(F.array(closed))).alias("v")).select("v.*")
    fresh = unmatched(changes, current, keys)
    first = initial(fresh.select(*keys, *tracked), at)
    return history.unionByName(versions).unionByName(first.select(*dim.columns))


def merge_by_values(dim: DataFrame, changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, dedup_by: Sequence[str] | None = None) -> DataFrame:
    """A new version when a tracked column differs; NULL differs from a value."""
    differs = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in tracked])
    return _apply(dim, changes, keys, tracked, differs, at, dedup_by)


def with_hash(rows: DataFrame, tracked: Sequence[str], name: str = "row_hash") -> DataFrame:
    return rows.withColumn(name, row_fingerprint(tracked))


def merge_by_hash(dim: DataFrame, changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, name: str = "row_hash", dedup_by: Sequence[str] | None = None) -> DataFrame:
    """Same, but decided by one stored fingerprint of the tracked columns."""
    hashed = with_hash(changes, tracked, name)
    return _apply(dim, hashed, keys, [*tracked, name], F.col(f"t.{name}") != F.col(f"s.{name}"), at, dedup_by)


def as_of(dim: DataFrame, at: Column) -> DataFrame:
    """The version of every key that was valid at a point in time."""
    return dim.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def current(dim: DataFrame) -> DataFrame:
    return dim.where("is_current")
