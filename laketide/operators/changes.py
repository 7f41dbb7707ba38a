"""Row changes between a target table and a source: merge family, change feed, deltas.

Operators return the new state; nothing is written. The target is never grouped or fully
joined: it is left-joined with the source. A source that is measured to be small is broadcast
and leaves a large target unshuffled, whatever the optimizer estimates for it; otherwise the
join is shuffled and adaptive execution can split a skewed target.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, is_small, row_bytes
from laketide.operators.windows import latest_per_key
from laketide.sources.evolution import common_schema, fit_to
from laketide.sources.writers import stored


class DuplicateSourceKey(ValueError):
    """Several source rows claim the same target row."""


class UnknownColumns(ValueError):
    """The source brings columns that the target lacks and nobody said what to do with them."""


def one_row_per_key(source: DataFrame, keys: Sequence[str], dedup_by: Sequence[str] | None) -> DataFrame:
    """The source with unique keys, hinted for a broadcast when it is small.

    Without ``dedup_by`` one pass over the source finds duplicate keys and its size."""
    if dedup_by is not None:
        one = latest_per_key(source, keys, dedup_by)
        return F.broadcast(one) if is_small(source) else one
    filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    per_key = source.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(row_bytes(source)).alias("b"))
    facts = per_key.agg(F.max(F.when(filled, F.col("n"))).alias("copies"), F.sum("n").alias("rows"), F.sum("b").alias("bytes")).first()
    if (facts["copies"] or 0) > 1:
        raise DuplicateSourceKey(f"source has several rows for one of {list(keys)}; pass dedup_by")
    small = (facts["rows"] or 0) <= BROADCAST_ROWS and (facts["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(source) if small else source


def _on(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__s_{k}") for k in keys])


def unmatched(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows without a target row. Only the target's key columns are read, and they are
    first cut down to the keys the source mentions."""
    keys = list(keys)
    wanted = source.select(*[F.col(k).alias(f"__s_{k}") for k in keys])
    known = target.select(*keys).join(wanted, _on(keys), "left_semi").distinct()
    return source.join(known, keys, "left_anti")


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    insert: Sequence[str] | None = None,
    when_matched: str | None = None,
    delete_when: str | None = None,
    dedup_by: Sequence[str] | None = None,
    evolve: bool = False,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """New state of ``target`` after merging ``source``.

    * ``update`` / ``insert``: columns to take from the source; default all shared columns.
      Columns an inserted row does not get are NULL. An empty list switches the clause off.
    * ``when_matched``: SQL condition for an update, with ``t.`` and ``s.`` prefixes.
    * ``delete_when``: SQL condition on source columns (``s.``) that removes the matched
      target row and keeps an unmatched source row out.
    * ``evolve``: columns that only the source has are added, and types are widened to the common
      type of both sides, at any depth; a struct is taken whole. Without it such columns are
      refused, unless ``ignore`` names them or a condition (``s.op``) or ``dedup_by`` uses them.
    """
    keys = list(keys)
    known = {c.lower() for c in target.columns}
    used = f"{when_matched or ''} {delete_when or ''}"
    ignore = [*ignore, *(dedup_by or []), *[c for c in source.columns if c.lower() not in known and re.search(rf"\bs\.`?{re.escape(c)}\b", used)]]
    unknown = [c for c in source.columns if c.lower() not in known and c not in ignore]  # refused below
    if evolve:
        grown = common_schema(target.schema, source.drop(*[c for c in ignore if c.lower() not in known]).schema)
        target = fit_to(target, grown)
        named = {c.lower() for c in source.columns}
        aside = [f for f in source.schema.fields if f.name in set(ignore) - set(keys) and f.name.lower() not in {g.name.lower() for g in grown.fields}]
        source = fit_to(source, T.StructType([*[f for f in grown.fields if f.name.lower() in named], *aside]))
    source = one_row_per_key(source, keys, dedup_by)
    if unknown and not evolve:
        raise UnknownColumns(f"the target lacks {unknown}; pass evolve=True to add them or name them in ignore")
    shared = [c for c in target.columns if c in source.columns]
    update = [c for c in shared if c not in keys] if update is None else list(update)
    insert = shared if insert is None else list(insert)

    pairs = target.alias("t").join(
        source.select("*", F.lit(True).alias("__hit")).alias("s"),
        reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]),
        "left",
    )
    hit = F.col("s.__hit").isNotNull()
    if delete_when is not None:
        pairs = pairs.where(~(hit & F.coalesce(F.expr(delete_when), F.lit(False))))
    take = hit & F.coalesce(F.expr(when_matched), F.lit(False)) if when_matched else hit
    kept = pairs.select(
        *[
            F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c)
            if c in update
            else F.col(f"t.{c}").alias(c)
            for c in target.columns
        ]
    )
    if not insert:
        return kept
    new = unmatched(source, target, keys)
    if delete_when is not None:
        new = new.alias("s").where(~F.coalesce(F.expr(delete_when), F.lit(False)))
    new = new.select(
        *[
            (F.col(c) if c in insert else F.lit(None)).cast(target.schema[c].dataType).alias(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(new)


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE: rows where the condition is false or NULL stay as they are."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE: removes rows where the condition is true, keeps false and NULL."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def _images() -> Column:
    """The change rows of a pair of images, ``b`` before and ``a`` after."""

    def image(kind: str, row: str) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("row"))

    return (
        F.when(F.col("b").isNull(), F.array(image("insert", "a")))
        .when(F.col("a").isNull(), F.array(image("delete", "b")))
        .otherwise(F.array(image("update_preimage", "b"), image("update_postimage", "a")))
    )


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """Row changes between two snapshots: insert, delete, update_preimage, update_postimage.

    Keys must be unique in each snapshot; NULL is a key like any other. Both sides are read in
    their common schema, so a new column or a wider type of ``after`` is part of the feed.
    Unchanged rows are dropped right after the join.
    """
    keys, schema = list(keys), common_schema(before.schema, after.schema)
    columns = schema.names
    a = fit_to(before, schema).select(F.struct(*columns).alias("b"), *[F.col(k).alias(f"__b_{k}") for k in keys])
    z = fit_to(after, schema).select(F.struct(*columns).alias("a"), *[F.col(k).alias(f"__a_{k}") for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(f"__b_{k}").eqNullSafe(F.col(f"__a_{k}")) for k in keys])
    pairs = a.join(z, same, "full_outer").where(~F.col("b").eqNullSafe(F.col("a")))

    feed = pairs.select(F.explode(_images()).alias("c")).select("c._change_type", "c.row.*")
    return feed if version is None else feed.withColumn("_commit_version", F.lit(version))


def net_feed(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changes of several commits composed: at most one change of a key, from its row before the
    first commit to its row after the last. ``feed`` has ``_commit_version`` and ``_commit_timestamp``;
    the result has those of the key's last commit. What was undone on the way is no change."""
    keys = list(keys)
    meta = ["_change_type", "_commit_version", "_commit_timestamp"]
    columns = [c for c in feed.columns if c not in meta]
    new = F.col("_change_type").isin("insert", "update_postimage")
    event = F.struct(new.alias("new"), F.struct(*columns).alias("row"), "_commit_version", "_commit_timestamp")
    place = F.struct("_commit_version", new.alias("new"))  # the old image of a commit before its new one
    ends = feed.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min_by(event, place).alias("first"), F.max_by(event, place).alias("last"))
    before = F.when(~F.col("first.new"), F.col("first.row"))
    after = F.when(F.col("last.new"), F.col("last.row"))
    moved = ends.select(before.alias("b"), after.alias("a"), "last._commit_version", "last._commit_timestamp").where(~F.col("b").eqNullSafe(F.col("a")))

    return moved.select(F.explode(_images()).alias("c"), "_commit_version", "_commit_timestamp").select("c._change_type", "c.row.*", "_commit_version", "_commit_timestamp")


def net_change(feed: DataFrame, keys: Sequence[str], measure: Column, name: str = "delta") -> DataFrame:
    """Signed sum per group: new images count plus, old images minus."""
    sign = F.when(F.col("_change_type").isin("insert", "update_postimage"), F.lit(1)).otherwise(F.lit(-1))
    return feed.groupBy(*keys).agg(F.sum(measure * sign).alias(name), F.sum(sign).alias("row_delta"))


def apply_delta(aggregate: DataFrame, delta: DataFrame, keys: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """Add a net change to a stored aggregate. ``pairs`` maps a stored column to its delta."""
    moved = delta.select(*keys, *[F.col(d).alias(f"__d_{d}") for d in pairs.values()])
    both = aggregate.join(moved, list(keys), "full_outer")
    zero = F.lit(0)
    return both.select(
        *keys,
        *[(F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"__d_{d}"), zero)).alias(c) for c, d in pairs.items()],
    )


def recompute_affected(
    aggregate: DataFrame, feed: DataFrame, rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column]
) -> DataFrame:
    """Rebuild only the groups the feed touches. A touched group that has no rows any more
    disappears from the result. The touched keys are stored: both joins read them, and their
    file size tells the optimizer whether to broadcast them."""
    keys = list(keys)
    touched = stored(feed.select(*keys).distinct(), "touched_keys")
    fresh = rows.join(touched, keys, "left_semi").groupBy(*keys).agg(*aggs)
    return aggregate.join(touched, keys, "left_anti").unionByName(fresh)
