"""Chat rendering of maximal conversations: logged snapshots that a longer log continues are dropped.

A turn is (turn, role, text); null roles and texts count as empty, a null turn comes first. The
prefix of a conversation up to a turn has a rolling hash: the exclusive or of two 64-bit hashes
of its turns, with their number. A conversation is a snapshot if its whole hash is a proper
prefix of another conversation; an anti-join drops it. Of equal conversations the smallest id
stays. The rest is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.

Rolling hashes are computed in two levels: one hash for each conversation and ``CHUNK`` turns,
then inside the chunks. So a conversation with very many turns is not one window, and its
rendering comes in parts of ``CHUNK`` turns; ordinary conversations are one part.

Defined results: repeated turn rows count once; several rows for one turn number are ordered by
role and text and belong to the prefix together; rows without a conversation id form one
conversation, in parts of ``CHUNK`` rows however few turn numbers they share; an empty table gives
no rows. With an id a part is ``turn // CHUNK``, as the SQL has it, with all rows of these turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laketide.llm.common import block_count, stored

CHUNK = 256
RANGE_ROWS = 1 << 16
LINE = ("turn", "role", "text")


def turns_of(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct turns with their chunk and two hashes."""
    t = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.coalesce("turn", F.lit(-(1 << 62)))
    return t.distinct().select(
        "*",
        F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-1)).cast("long").alias("part"),
        F.xxhash64(number, "role", "text").alias("x"),
        F.xxhash64(F.lit("second"), "text", "role", number).alias("y"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """For each conversation and turn number: how many turns there are up to it and their rolling hashes."""
    sums = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("conv_id").alias("c"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bn"),
        F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("bx"),
        F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("by"),
    )
    steps = turns.groupBy("conv_id", "part", "turn").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    upto = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, 0)
    inner = steps.select("conv_id", "part", "turn", F.sum("n").over(upto).alias("n"), F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"))
    joined = inner.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", "turn", (F.col("n") + F.col("bn")).alias("n"), F.col("x").bitwiseXOR(F.col("bx")).alias("x"), F.col("y").bitwiseXOR(F.col("by")).alias("y"))


def maximal(turns: DataFrame) -> DataFrame:
    """Ids of the conversations that no other one continues, one for each content."""
    steps = stored(prefixes(turns), "prefixes")
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    whole = stored(whole, "whole")
    size = whole.select(F.col("conv_id").alias("c"), F.col("n").alias("size"))
    proper = steps.join(size, F.col("conv_id").eqNullSafe(F.col("c"))).where("n < size").select("n", "x", "y").distinct()
    kept = whole.join(proper, ["n", "x", "y"], "left_anti")
    return kept.groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("n").alias("n_turns"))


def _by_rows(turns: DataFrame, n_turns: int, chunk: int) -> DataFrame:
    """The rows of the conversation without an id, ``chunk`` of them in a part, in the order of their lines.

    Ranges of the order are numbered each by itself, then the sizes of the ranges before are added.
    """
    ranges = block_count(turns, F.lit(1), RANGE_ROWS)
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # stored: the bounds of the ranges are drawn from a sample
    dealt = stored(turns.select("conv_id", *LINE).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "lone")
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for i in range(ranges):
        before.append(at)
        at += sizes.get(i, 0)
    number = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("range"))
    return dealt.select("conv_id", F.floor(number / chunk).cast("long").alias("part"), F.lit(n_turns).cast("long").alias("n_turns"), *LINE)


def render(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns`` (of the whole conversation) and ``rendered`` of every maximal conversation."""
    turns = stored(turns_of(conversations, chunk), "turns")
    kept = stored(maximal(turns).withColumnRenamed("conv_id", "c"), "kept")
    rows = turns.where("conv_id IS NOT NULL").join(kept, F.col("conv_id") == F.col("c")).select("conv_id", "part", "n_turns", *LINE)
    lone = kept.where("c IS NULL").first()
    if lone is not None:
        rows = rows.unionByName(_by_rows(turns.where("conv_id IS NULL"), lone["n_turns"], chunk))
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    # turn numbers, roles and texts order the lines; the struct sorts by its fields
    rows = rows.select("conv_id", "part", "n_turns", F.struct(*LINE, line.alias("line")).alias("t"))
    parts = rows.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("rendered"))
