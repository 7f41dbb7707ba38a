import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from laketide.llm import lm_trie
from laketide.llm.elias_fano import EliasFano, Trie


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (10, 3), (1000, 10**6), (5000, 5000), (3, 0), (64, 10**9)):
        v = np.sort(rng.integers(0, top + 1, n))
        assert (EliasFano.build(v)[np.arange(n)] == v).all()


def test_trie():
    strings = {b"a": (1, 0), b"ab": (2, 9), b"ac": (3, 9), b"b": (4, 0), b"bcd": (5, 8), b"bce": (6, 8)}
    number = lambda s: int.from_bytes(s.ljust(3, b"\0"), "big")
    keys = np.array([number(s) for s in strings], dtype=np.uint64)
    depth = np.array([len(s) for s in strings])
    own, context = (np.array([v[i] for v in strings.values()], dtype=np.uint16) for i in range(2))
    raw = np.frombuffer(Trie.build(keys, depth, own, context, 3).tobytes(), np.uint8)
    trie = Trie.view(raw)
    for s in (*strings, b"c", b"ad", b"bc", b"zzz", b"bcf"):
        got = [int(x[0]) for x in trie.find(np.array([number(s)], dtype=np.uint64), len(s), 3)]
        parent = next((v[1] for t, v in strings.items() if len(t) == len(s) and t[:-1] == s[:-1]), 0)
        assert got == [strings.get(s, (0, 0))[0], parent], s


def brute(rows, train, order):
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    counts, after = Counter(), defaultdict(Counter)
    line = [b"\xfe" * (order - 1) + b" ".join(w) + (b" " if w else b"") + b"\xff" for w in tokens]
    for w, s, use in zip(tokens, line, train, strict=True):
        if use:
            counts.update([*w, None])
            for j in range(order - 1, len(s)):
                for k in range(order):
                    after[s[j - k : j]][s[j]] += 1
    n, v = sum(counts.values()), len(counts)

    def spelled(s, j):
        p = 1 / 257
        for k in range(order):
            if d := after.get(s[j - k : j]):
                total = sum(d.values())
                p = (d.get(s[j], 0) + len(d) * p) / (total + len(d))
        return math.log10(p)

    out = []
    for w, s in zip(tokens, line, strict=True):
        base = [math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]]
        sums, at = [], order - 1
        for x in [*w, b""]:
            stop = at + len(x) + 1
            sums.append(sum(spelled(s, j) for j in range(at, stop)))
            at = stop
        score = sum(max(a, b) + math.log10(0.5 + 0.5 * 10 ** (min(a, b) - max(a, b))) for a, b in zip(sums, base, strict=True))
        out.append((len(base), sum(counts.get(x, 0) > 0 for x in [*w, None]), n, sum(base), score))
    return out


@pytest.mark.parametrize("order,block_bytes,fan_in", [(4, 8 << 20, 256), (6, 700, 3)])
def test_scores(docs, corpus, order, block_bytes, fan_in):
    numbered = docs.select(F.col("doc_id").alias("row"), "text", (F.col("doc_id") % 5 != 0).alias("use"))
    got = lm_trie.train_and_score(numbered, F.col("use"), order, block_bytes, fan_in).collect()
    train = [i is not None and i % 5 != 0 for i, _ in corpus]
    want = [(i, not u, *b) for (i, _), u, b in zip(corpus, train, brute(corpus, train, order), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=3e-3)  # 16-bit codes


def test_nothing_to_learn(docs, empty):
    rows = lm_trie.train_and_score(docs.select(F.col("doc_id").alias("row"), "text"), F.lit(False)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    assert lm_trie.train_and_score(empty.select(F.col("doc_id").alias("row"), "text"), F.lit(True)).count() == 0


def test_adding_up_holds_few_arrays():
    """Exact sums over blocks; the working arrays of a shard are at most 46 bytes an entry."""
    import tracemalloc

    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 150_000, 20_000).astype(np.uint64)) for _ in range(12)]
    pairs = [(k, rng.integers(0, 1 << 40, len(k))) for k in parts]
    tracemalloc.start()
    keys, sums = lm_trie._add_up(pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = defaultdict(int)
    for k, c in pairs:
        for a, b in zip(k.tolist(), c.tolist(), strict=True):
            want[a] += b
    assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == want and keys.tolist() == sorted(want)
    assert peak <= 46 * sum(map(len, parts))
    assert [len(x) for x in lm_trie._add_up([(np.zeros(0, np.uint64), np.zeros(0, np.int64))])] == [0, 0]
