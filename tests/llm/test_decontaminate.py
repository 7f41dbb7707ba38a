import random

from laketide.llm import decontaminate
from tests.llm.conftest import prose


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    best = {}
    for d, text in docs:
        for i, item in items:
            s = grams(item)
            if s and 100 * len(s & grams(text)) >= 80 * len(s):
                new = (len(s & grams(text)) / len(s), len(s), len(s & grams(text)))
                best[d, i] = max(best.get((d, i), new), new)
    return {(d, i, b[1], b[2], b[0]) for (d, i), b in best.items()}


def test_pairs_and_clean(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(6, 70))) for i in range(30)] + [(30, "too few words"), (31, None), (2, prose(rng, 12))]
    items.append(items[0])
    docs = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 1500)).split()
        if i % 2:
            item = items[i % 30][1].split()
            if i % 3 == 0:
                item[len(item) // 2] = "altered"
            if i % 7 == 0:  # in two parts, far from each other
                words = item[: len(item) // 2 + 2] + words + item[len(item) // 2 - 2 :]
            else:
                at = rng.randint(0, len(words))
                words = words[:at] + [w.upper() for w in item] + words[at:]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[4][1]), (1, docs[1][1]), (1, "nothing here")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, keys string, item_id int")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, grams string")
    want = brute(docs, items)
    assert {tuple(r) for r in decontaminate.pairs(d, b).collect()} == want
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert rows == sorted((r for r in docs if not brute([r], items)), key=repr)
    assert decontaminate.pairs(d.where("false"), b).count() == decontaminate.pairs(d, b.where("false")).count() == 0
    assert decontaminate.clean(d, b.where("false")).count() == len(docs)
