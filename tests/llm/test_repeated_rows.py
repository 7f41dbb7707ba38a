"""Rows that share id and text, many times over."""

import random

import pytest
from pyspark.sql import functions as F

from laketide.llm import bwt_dedup, fm_dedup, fragments
from tests.llm.conftest import prose
from tests.llm.test_substrings import brute

COPIES = 2000


@pytest.mark.parametrize("operator,unit,length", [(fm_dedup, "word", 35), (bwt_dedup, "byte", 400)])
def test_null_ids(spark, monkeypatch, operator, unit, length):
    """Ranges of a text do not grow with the number of its rows, nor do the pieces that a shard gets."""
    rng = random.Random(5)
    text, other = prose(rng, 200), prose(rng, 60)
    ids = spark.range(COPIES).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    few = [(1, other + " " + text[300:1200]), (2, other), (3, prose(rng, 80))]
    docs = ids.coalesce(2).unionAll(spark.createDataFrame(few, "doc_id long, text string"))
    longest, pieces = [], []
    whole, keep = operator.repeated_windows, fragments.stored

    def watched(*args, **options):
        spans = whole(*args, **options)
        longest.append(spans.agg(F.max(F.size("lo"))).first()[0])
        return spans

    def counted(df, label):
        out = keep(df, label)
        if label == "pieces":
            pieces.append(out.count())
        return out

    monkeypatch.setattr(operator, "repeated_windows", watched)
    monkeypatch.setattr(fragments, "stored", counted)
    rows = operator.removed(docs).groupBy("doc_id", "repeats.n_removed", F.col(f"repeats.n_{unit}s").alias("n"), "repeats.kept_sha256").count().collect()
    units = (lambda t: t.encode().split()) if unit == "word" else str.encode
    want = brute([(None, text), (None, text), *few], units, length, b" ".join if unit == "word" else bytes)[1:]
    assert {tuple(r) for r in rows} == {(i, w[1], w[0], w[3], c) for (i, c), w in zip([(None, COPIES), (1, 1), (2, 1), (3, 1)], want, strict=True)}
    assert longest[0] <= len(text)
    assert pieces[0] <= 16 * len(text)
