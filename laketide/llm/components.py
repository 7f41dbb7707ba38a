"""Connected components by alternating star contraction; no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laketide.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest
    neighbour. A chain of n nodes takes about log n rounds. Minima are taken per task first,
    and joins with a node of very many neighbours can be split by adaptive execution.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).distinct()
    state = stored(pairs, "links")
    while not _stars(state):
        both = state.unionAll(state.select(F.col("r").alias("v"), F.col("v").alias("r")))
        low = both.groupBy("v").agg(F.min("r").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("r > v").select(F.col("r").alias("v"), F.col("m").alias("r")).distinct()
        least = large.groupBy("v").agg(F.min("r").alias("m"))
        small = large.join(least, "v").where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r"))
        following = stored(small.unionAll(least.select("v", F.col("m").alias("r"))).distinct(), "links")
        drop_stored(state)
        state = following
    roots = state.groupBy("v").agg(F.min("r").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionAll(state.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct())


def _stars(state: DataFrame) -> bool:
    """Whether every link leads to a root: each node has one link, and no target has a link of its own."""
    ends = state.select(F.col("v").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionAll(state.select("r", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("x").agg(F.sum("out").alias("o"), F.max("in_").alias("i"))
    return per_node.where("o > 1 OR (o = 1 AND i = 1)").isEmpty()
