"""A corpus pipeline over ``documents``: stages of the text operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns the columns of
documents, but for the last, which returns the encoded documents. ``n_chars`` follows the text
where a stage cuts text away.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.llm import bpe, bwt_dedup, decontaminate, near_dedup, quality_llr
from laketide.llm.common import stored, table

SHINGLE = 5
#: Bytes of a repeated string. Passages of 50 words are often shorter than the 400 bytes of op10's contract.
REPEATED = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or the likelihood ratio go."""
    weights = quality_llr.learn_weights(docs, table(spark, sf_dir, "labels"))
    return quality_llr.judge(docs, weights, into="__quality").where("__quality.kept").drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; shingles of ``SHINGLE`` words, one more than op5's contract has."""
    return near_dedup.representatives(docs, k=SHINGLE)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of ``REPEATED`` bytes that start elsewhere too go, as does a character cut in two."""
    cut = bwt_dedup.removed(docs, length=REPEATED, into="__repeats")
    changed = F.col("__repeats.n_removed") > 0
    text = F.when(changed, F.col("__repeats.kept_text")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with the digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoded(docs.select(F.col("doc_id").alias("row"), "text"), ranks, public_tokenizers.PATTERN, digest=True).withColumnRenamed("row", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_items", benchmark_items),
    ("byte_bpe", byte_bpe),
]

#: The stages hash with Spark's functions and merge tokens; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
