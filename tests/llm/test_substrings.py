import hashlib
from collections import Counter

import numpy as np
import pytest

from laketide.llm import bwt_dedup, fm_dedup


def brute(rows, units, length, join):
    """Units of each row left after removing every repeated window."""
    texts = [units(t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(join([u for u, g in zip(t, gone, strict=True) if not g])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_bytes(docs, corpus, hot):
    got = bwt_dedup.removed(docs, hot=hot, shard_units=3000)
    assert got.columns == [*docs.columns, "repeats"]
    rows = sorted(((r["doc_id"], r["text"], *r["repeats"][:4]) for r in got.collect()), key=repr)
    want = brute(corpus, lambda t: t.encode(), 400, bytes)
    assert rows == sorted(((*r, *w) for r, w in zip(corpus, want, strict=True)), key=repr)
    for r in got.collect():
        if not r["repeats"]["n_removed"]:
            assert r["repeats"]["kept_text"] == (r["text"] or "")


@pytest.mark.parametrize("hot", [1, 4096])
def test_words(docs, corpus, hot):
    got = fm_dedup.removed(docs, hot=hot, shard_units=300)
    rows = sorted(((r["doc_id"], r["text"], *r["repeats"][:3]) for r in got.collect()), key=repr)
    want = brute(corpus, lambda t: t.encode().split(), 35, b" ".join)
    assert rows == sorted(((*r, w[0], w[1], w[3]) for r, w in zip(corpus, want, strict=True)), key=repr)


def test_no_rows(empty):
    assert bwt_dedup.removed(empty).count() == fm_dedup.removed(empty).count() == 0


def test_transforms_by_parts():
    """Merged transforms agree with counting, however a shard is cut into parts."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        alphabet = b"ab" if trial % 2 else b"abcdefgh"
        base = bytes(rng.choice(list(alphabet), 150).tolist())
        lead, pieces = [], []
        for _ in range(int(rng.integers(1, 9))):
            at = int(rng.integers(0, 60))
            pieces.append(base[at : at + int(rng.integers(12, 90))])
            lead.append((120 - at) % 4)  # blocks are cut from one place of the base
        counts = [max(0, len(p) - 11) for p in pieces]
        seen = Counter(p[i : i + 12] for p, n in zip(pieces, counts, strict=True) for i in range(n))
        got = bwt_dedup.flags_of_shard(pieces, counts, lead, 12, 4, part=int(rng.integers(1, 40)))
        for p, n, at, flags in zip(pieces, counts, lead, got, strict=True):
            for i in range(n):
                if flags[i]:
                    assert seen[p[i : i + 12]] > 1
        if alphabet != b"ab":  # equal windows are equally placed, as fragments of one anchor are
            assert [f.tolist() for f in got] == [[seen[p[i : i + 12]] > 1 for i in range(n)] for p, n in zip(pieces, counts, strict=True)]


def test_matching_statistics():
    rng = np.random.default_rng(4)
    text = np.concatenate((rng.integers(2, 5, 200), [0]))
    reach = fm_dedup.matching_statistics(text, np.zeros(len(text), dtype=np.int64), 8)
    s = bytes(text.tolist())
    for e in range(200):
        best = 0
        for m in range(1, min(8, e + 1) + 1):
            part = s[e - m + 1 : e + 1]
            if sum(s[i : i + m] == part for i in range(len(s) - m + 1)) > 1:
                best = m
            else:
                break
        assert reach[e] == best


def test_index_takes_four_bytes_a_bit_and_symbol():
    text = np.append(np.random.default_rng(2).integers(2, 300, 5000), 0)
    index = fm_dedup.FMIndex(text, 6)
    assert sum(z.nbytes for z in index.zeros) <= 4 * index.bits * (len(text) + 1)
    symbol, at = text[:50], np.arange(50) * 100
    lo, hi = index.extend(symbol, at, at + 90)
    assert (lo <= hi).all() and (hi - lo <= 90).all()
