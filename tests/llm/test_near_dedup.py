from itertools import combinations

import numpy as np
import pytest

from laketide.llm import near_dedup
from laketide.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    """Component of each id, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a != b and s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("rounds,per_node", [(2, 4), (0, 4), (3, 0)])
def test_groups(docs, corpus, monkeypatch, rounds, per_node):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "PAIRS_PER_NODE", per_node)
    got = sorted((tuple(r) for r in near_dedup.groups(docs).collect()), key=repr)
    roots = brute(corpus)
    want = [(i, len(shingles(t)), roots.get(i), i is None or roots[i] == i) for i, t in corpus]
    assert got == sorted(want, key=repr)


def test_chain_and_several_texts(spark):
    """A chain of links is one group though its ends differ; an id with two texts joins both."""
    w = [f"w{i}" for i in range(100)]
    rows = [(10 - i, " ".join([*w[i * 4 :], *[f"x{j}" for j in range(i * 4)]])) for i in range(6)]
    rows += [(20, "p q r s t"), (21, "k l m n o"), (22, "p q r s t"), (22, "k l m n o")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.groups(df).collect()}
    assert got == {(i, c) for i, c in brute(rows).items()} | {(20, 20), (21, 20), (22, 20)}


def test_representatives(docs, corpus):
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    roots = brute(corpus)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([*{i for i in roots if roots[i] == i}, None, None], key=repr)


def test_sketch_estimates():
    """All coordinates are filled and agree in about the share of the similarity, also for tiny sets."""
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n // 4 : n + n // 4])
        got = near_dedup.sketches([a, b, np.zeros(0, np.uint64)], 1000)
        assert (got[:2] != np.iinfo(np.uint64).max).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((got[0] == got[1]).mean() - true) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_no_rows(empty):
    assert near_dedup.groups(empty).count() == near_dedup.representatives(empty).count() == 0


def test_star_rounds_move_no_texts_of_unlike_sketches(spark, monkeypatch):
    """Texts made of the same paragraphs share every shingle but only half of them pairwise: they meet in buckets and the bound lets them pass."""
    rng = np.random.default_rng(5)
    paragraphs = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(24)]
    rows = [(i, " ".join(paragraphs[j] for j in sorted(rng.choice(24, 14, replace=False)))) for i in range(60)]
    assert not [1 for (_, s), (_, t) in combinations(rows, 2) if 100 * len(shingles(s) & shingles(t)) >= 80 * len(shingles(s) | shingles(t))]
    compared, plain = [], near_dedup.similar

    def similar(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "similar", similar)
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.kept for r in got)
    assert compared and sum(compared) < 100  # 2109 when every pair of a star round moved its texts
