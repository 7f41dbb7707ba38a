import random

import numpy as np
import pytest

from laketide.llm import language_ppm

SOUNDS = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "es", "um"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(SOUNDS) * 30)] + [(900, None, "aa"), (901, "kato", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_predictions(spark, labelled):
    trees = language_ppm.learn(labelled)
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randint(3, 2000)), lang) for i, lang in enumerate(list(SOUNDS) * 5)]
    rows += [(50, None, "und"), (51, "", "und"), (52, "12 3.4 !!", "und"), (None, text(rng, "bb"), "bb"), (53, "東京", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth string")
    got = language_ppm.predict(df, trees).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["truth"] in (None, r["lang_pred"])
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0)
    assert next(r for r in got if r["doc_id"] == 53)["lang_pred"] in SOUNDS


def plain_bits(texts, order, min_count):
    """Code lengths by the definition: counts in dictionaries, exclusion with sets. Returns a function of a text."""
    simple = lambda t: [32 if c in b"\t\n\x0b\x0c\r" or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in t.encode()]
    tree = {}
    for t in texts:
        s = [32] * order + simple(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                node = tree.setdefault(tuple(s[i - k : i]), {})
                node[s[i]] = node.get(s[i], 0) + 1
    tree = {c: n for c, n in tree.items() if not c or sum(n.values()) >= min_count}

    def probability(context, byte):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            node = {b: n for b, n in tree.get(tuple(context[order - k :]), {}).items() if b not in out}
            if not node:
                continue
            whole = sum(node.values()) + len(node)
            if byte in node:
                return p * node[byte] / whole
            p *= len(node) / whole
            out |= set(node)
        return p / (256 - len(out))

    def bits(t):
        s = [32] * order + simple(t)
        return -sum(np.log2(probability(s[i - order : i], s[i])) for i in range(order, len(s)))

    return bits


@pytest.mark.parametrize("part_codes", [1 << 20, 1])
def test_brute_force(spark, labelled, part_codes):
    """Predictions and scores at the production order, with all trees in one part and with a part for each."""
    rows = [(r["text"], r["lang"]) for r in labelled.collect() if r["text"] and r["lang"]]
    plain = {x: plain_bits([t for t, lang in rows if lang == x], language_ppm.ORDER, language_ppm.MIN_COUNT) for x in SOUNDS}
    rng = random.Random(4)
    texts = [text(rng, rng.choice(list(SOUNDS)), rng.randint(1, 40)) for _ in range(25)] + ["ka", "東京 x", "KaTO 12\tmi"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_ppm.predict(df, language_ppm.learn(labelled, part_codes=part_codes)).collect()}
    for i, t in enumerate(texts):
        bits = {x: plain[x](t) for x in sorted(plain)}
        best = min(bits, key=bits.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(2.0 ** (bits[best] - b) for b in bits.values()), rel=1e-6)


def test_every_language_can_be_predicted(spark):
    """More languages than any fixed number: each has a letter pair of its own, the rare ones two rows."""
    names = [f"l{i:03}" for i in range(260)]
    sign = {x: chr(0x4E00 + 37 * i) for i, x in enumerate(names)}
    rows = [(i, (sign[x] + " ") * 30, x) for i, x in enumerate(names * 2)] + [(1000 + i, (sign["l000"] + " ") * 30, "l000") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_ppm.learn(df, part_codes=500)
    assert len(model.parts) > 1
    assert all(r["lang_pred"] == r["lang"] for r in language_ppm.predict(df, model).collect())


def test_distributions_add_up(labelled):
    model = language_ppm.learn(labelled, order=2)
    for tree in model.parts[0][1].value:
        for context in (b"ka", b"ng", b"qq", b"  ", "ç".encode()):
            codes = (np.uint64(int.from_bytes(context, "big") << 8)) + np.arange(256, dtype=np.uint64)
            assert np.exp2(-tree.bits(codes)).sum() == pytest.approx(1, abs=1e-9)


def test_code_length_by_hand():
    """One language, order 1, text "aab": costs from the counts by hand, with exclusion."""
    start = language_ppm.START
    tree = language_ppm.Tree(np.array([(start << 8) | 97, (97 << 8) | 97, (97 << 8) | 98], dtype=np.uint64), np.array([1, 1, 1]), 1, 1)
    # after start: a 1 of 2; after a: a 1/4, b 1/4
    assert language_ppm.lengths([b"aab"], [tree], 1)[0, 0] == pytest.approx(-np.log2(1 / 2 * 1 / 4 * 1 / 4), rel=1e-6)
    # start then b: escape 1/2; the empty context without a: b 1 of 2
    assert language_ppm.lengths([b"b", b""], [tree], 1)[:, 0].tolist() == pytest.approx([2, 0], rel=1e-6)


def test_long_text_in_stretches():
    tree = language_ppm.Tree(np.array([(97 << 8) | 98, (98 << 8) | 97], dtype=np.uint64), np.array([5, 5]), 1, 1)
    n = (1 << 22) // 2 + 5
    whole = language_ppm.lengths([b"ab" * n], [tree], 1)[0, 0]
    two, three = (language_ppm.lengths([b"ab" * k], [tree], 1)[0, 0] for k in (2, 3))
    assert whole == pytest.approx(two + (n - 2) * (three - two), rel=1e-9)


def test_nothing_to_learn(labelled):
    none = language_ppm.learn(labelled.where("lang IS NULL"))
    assert none is None
    assert {r["lang_pred"] for r in language_ppm.predict(labelled, none).collect()} == {"und"}
    assert language_ppm.predict(labelled.where("false"), language_ppm.learn(labelled)).count() == 0
