"""Set operations between tables and table versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name, columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled_counts(frames: Mapping[str, DataFrame], label: str = "layer") -> DataFrame:
    """One count row per named frame, all in one job."""
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias(label), "rows") for n, df in frames.items()]
    return reduce(DataFrame.union, rows)


def two_way_difference(now: DataFrame, then: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one of the two versions has."""
    added = now.exceptAll(then).withColumn("side", F.lit("added"))
    removed = then.exceptAll(now).withColumn("side", F.lit("removed"))
    return added.union(removed)
