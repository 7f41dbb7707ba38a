import numpy as np

from laketide.llm import near_dedup


def copies(n, changes, seed, name="w"):
    """Copies of one text of 100 words, each with so many words changed at random places, some to the same few words."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [f"{name}{i}" for i in range(100)]
        for at in rng.choice(100, rng.integers(changes[0], changes[1] + 1), replace=False):
            words[at] = rng.choice(["x", "y", f"own{rng.integers(1 << 40)}"])
        out.append(" ".join(words))
    return out


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}


def linked(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def meeting(spark, texts):
    """The pairs of one large bucket that has every text."""
    rows = [(i, t, len(shingles(t))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "node long, text string, n long")
    many = docs.selectExpr("7L AS key", "node", "node AS root", "n", "n AS a")
    got = near_dedup._meeting(many, docs.select("node", "text"), 80, 4).collect()
    return {tuple(sorted((r.node, r.b))) for r in got}


def test_meeting_loses_no_link(spark):
    """Pairs that meet connect what the links of all pairs connect, with texts near to the base, far from it, and of other bases."""
    texts = copies(30, (0, 2), 1) + copies(50, (3, 6), 2) + copies(12, (4, 5), 3, "v") + copies(6, (0, 9), 4, "u")
    sets = [shingles(t) for t in texts]
    pairs = {(a, b) for a, b in meeting(spark, texts) if linked(sets[a], sets[b])}
    root = list(range(len(sets)))
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert root == components(sets) and len(set(root)) > 3


def test_copies_just_too_different_rarely_meet(spark):
    """Of a large group of copies below the threshold few pairs meet; before, all pairs of a bucket did."""
    texts = copies(200, (4, 5), 8)
    assert len(meeting(spark, texts)) < 0.1 * 200 * 199 / 2


def test_large_buckets_give_the_same_groups(spark, monkeypatch):
    texts = copies(60, (1, 6), 5) + copies(10, (2, 4), 6, "v")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    called, plain = [], near_dedup._meeting
    monkeypatch.setattr(near_dedup, "_meeting", lambda *a: called.append(1) or plain(*a))
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components([shingles(t) for t in texts]) and called
