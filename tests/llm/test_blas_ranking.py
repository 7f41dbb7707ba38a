"""Ranked search against plain sums over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from laketide.llm import blas_ranking as ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    big_n, big_l = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, wanted in merged.items():
        found = []
        for doc, have, n in counts:
            m = 25 + (75 * n * big_n) // max(big_l, 1)
            score = sum(r * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * have[t]) // (1000 * have[t] + 8 * m)) for t, r in wanted.items() if have[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out |= {(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def items(spark, corpus):
    rng = random.Random(9)
    words = [t for _, text in corpus for t in terms(text)[:40]]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "!!"), (93, "nowhereatall"), (94, "THE the The"), (5, "shore é entire"), (None, "noble"), (95, "é" * 300), (96, "the " * 5000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int")


@pytest.mark.parametrize("entries", [1 << 18, 150])
def test_all_pairs(docs, corpus, items, entries):
    rows, frame = items
    got = {tuple(r) for r in ranking.ranked(docs, frame, block_entries=entries).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == brute(corpus, rows)


def test_more_documents_than_a_tile(spark, monkeypatch):
    """Ties across tiles and tasks: the smallest ids win."""
    docs = [(i, "same text here") for i in range(3000, 0, -1)] + [(5000, "same")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = [(1, "same text"), (2, "here")]
    got = {tuple(r) for r in ranking.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), k=7).collect()}
    assert got == brute(docs, items, 7)


def test_counts_spread_over_rows():
    rng = np.random.default_rng(3)
    entries = [(np.sort(rng.choice(40, 9, replace=False)), rng.integers(1, 500, 9)) for _ in range(5)]
    whole = ranking.ItemTile(list(range(5)), entries, 1 << 40)
    cut = ranking.ItemTile(list(range(5)), entries, 7)
    assert cut.counts.sum(axis=1).max() <= 7 and len(cut.counts) > len(whole.counts)
    impacts = rng.integers(0, 1 << 34, (len(whole.terms), 11)).astype(float)
    assert (whole.scores(impacts) == cut.scores(impacts)).all()


def test_products_stay_exact(spark):
    """A term repeated so often in an item that one row would pass 2**53."""
    docs = [(i, "rare " + "w" * (i % 5 + 1) + " filler" * (i % 7)) for i in range(60)]
    items = [(1, "w www rare " * 300_000)]
    got = {tuple(r) for r in ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)


def test_empty_tables(spark, docs, empty, items):
    none = items[1].where("false")
    assert ranking.ranked(docs, none).count() == 0
    assert ranking.ranked(empty, items[1]).count() == 0
    assert ranking.ranked(empty, items[1]).columns == ranking.ranked(docs, none).columns == ["item_id", "rank", "doc_id", "score"]
