"""Quality verdicts: a hashed n-gram log-likelihood ratio beside fixed word rules.

Words and word pairs are hashed into ``BUCKETS`` bins. Two multinomials are counted over them:
the target from documents labelled good (quality 1, never toxic), the raw one from every
document. A text's score is the mean over its n-grams of log p_target - log p_raw, so long
and short texts compare; a text is kept if it passes the word rules and the score is at least
``THRESHOLD``. Everything is a DataFrame expression.

Only the target is fitted on a bounded sample: the ``TARGET_ROWS`` good labels with the
smallest hashed ids. Their ids are broadcast, so the corpus is never shuffled; what crosses
the network is one row per bin and task.

Defined results: a null or empty text has no words and fails the rules. Null and repeated ids
are judged row by row. Without a good label all weights are 0 and only the word rules decide.
A document labelled both ways is not in the target. Other columns are passed on untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.llm.common import SPACE, packed, words_of

BUCKETS = 10_000
TARGET_ROWS = 20_000
THRESHOLD = -0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _grams(words: Column, size: Column, buckets: int) -> Column:
    singles = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.pmod(F.xxhash64(words[i], words[i + 1]), F.lit(buckets)).cast("int"))
    return F.when(size > 1, F.concat(singles, pairs)).otherwise(singles)


def good_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of at most ``rows`` documents labelled good only, those with the smallest hashes."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .where("q = 1 AND coalesce(t, 0) = 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id")
    )


def learn_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> list[float]:
    """The log ratio of every bin, with one added to each count. At most ``buckets`` rows reach the driver."""
    good = good_ids(labels, rows).withColumn("good", F.lit(1))
    marked = docs.select("doc_id", words_of(F.col("text")).alias("w")).join(F.broadcast(good), "doc_id", "left")
    counts = (
        marked.withColumn("n", F.size("w"))
        .select("good", F.explode(_grams(F.col("w"), F.col("n"), buckets)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
        .collect()
    )
    target, raw = [0] * buckets, [0] * buckets
    for r in counts:
        target[r["bin"]], raw[r["bin"]] = r["target"], r["raw"]
    if not any(target):
        return [0.0] * buckets
    shift = math.log(sum(raw) + buckets) - math.log(sum(target) + buckets)
    return [math.log(t + 1) - math.log(a + 1) + shift for t, a in zip(target, raw, strict=True)]


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur again: sort (window, place), keep equal neighbours, spread over three words."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def cover(t: Column) -> Column:
        again = F.filter(t, lambda x, i: ((i > 0) & (t[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(t) - 1) & (t[F.least(i + 1, F.size(t) - 1)]["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.transform(F.array(placed), cover)[0]


def judge(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD, into: str = "quality") -> DataFrame:
    """Every row of ``docs`` with one more column: a struct of the counts, the score and the verdict."""
    buckets = len(weights)
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(packed(docs).alias("row"))
    df = df.select("row", words_of(F.col("row.text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(SPACE.replace("[", "[^")))).alias("lines"))
    df = df.withColumn("n", F.size("w"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))
    df = df.select(
        "row",
        "n",
        F.char_length(F.array_join("w", "")).alias("chars"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).alias("symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"),
        F.when(F.col("n") > 2, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        _grams(F.col("w"), F.col("n"), buckets).alias("grams"),
    )
    df = df.withColumn("distinct", F.size(F.array_distinct("windows")))
    df = df.withColumn("repeat", F.when(F.col("distinct") == F.size("windows"), 0).otherwise(_repeated(F.col("windows"))))
    df = df.withColumn("llr", F.coalesce(F.aggregate("grams", F.lit(0.0), lambda a, b: a + table[b]) / F.nullif(F.size("grams"), F.lit(0)), F.lit(0.0)))
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("repeat").cast("long") > MAX_REPEAT_PERCENT * F.col("n").cast("long"))
    # exploding an array of one keeps later filters above all this: pushed below, they would
    # take the place of the stored words and cut the text again for every word
    verdict = F.explode(F.array(
        F.struct(
            F.col("n").cast("long").alias("n_words"),
            F.col("chars").cast("long").alias("word_chars"),
            F.col("symbols").cast("long").alias("n_symbols"),
            F.col("dup_lines").cast("long").alias("n_dup_lines"),
            F.col("repeat").cast("long").alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (F.col("llr") >= threshold)).alias("kept"),
            F.col("llr"),
        )
    ))
    return df.select("row", verdict.alias(into)).select("row.*", into)
