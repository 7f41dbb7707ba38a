import random

import pytest

WORDS = "the of and to in is that for was with on be at by this from thing shore entire rested noble".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ly", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, null, empty, blank, repeated rows, null ids, one long text."""
    rng = random.Random(7)
    base = prose(rng, 300)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    words = base.split()
    for i in range(40, 52):
        w = list(words)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    for i in range(52, 60):
        rows.append((i, prose(rng, 30) + "\n" + passage + " " + prose(rng, 20)))
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "a a a a " * 150), (64, "é" * 300 + " x"), (65, "one two three")]
    rows += [(66, prose(rng, 4000)), (None, base), (None, None), (60, None), (3, rows[3][1]), (67, "One TWO three"), (68, "ab" * 700)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators might use themselves."""
    kind = "doc_id long, text string, row string, kept boolean, mark int, n_words string, lo int, block int"
    return spark.createDataFrame([(*r, "x", None, 1, "n", 2, 3) for r in corpus], kind).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
