from itertools import product

import pytest
from pyspark.sql import functions as F

from laketide.llm import lm_trie


@pytest.mark.parametrize("learned", [["ab a b", "a a ba", "b"], ["a" * 5], []])
def test_texts_sum_to_at_most_one(spark, learned):
    """Different texts of no, one or two words, seen and unseen: their probabilities sum to at most 1."""
    words = ["".join(w) for n in (1, 2, 3) for w in product("abcd", repeat=n)]
    rows = [(-i - 1, t, True) for i, t in enumerate(learned)]
    rows += [(i, w, False) for i, w in enumerate(words)] + [(1000 + i, f"{w} {w}", False) for i, w in enumerate(words)]
    rows += [(2000, "", False)]
    df = spark.createDataFrame(rows, "row long, text string, use boolean")
    scores = {r["row"]: r["score"] for r in lm_trie.train_and_score(df, F.col("use"), order=3).where("row >= 0").collect()}
    texts = sum(10 ** scores[i] for i in [*range(len(words)), *range(1000, 1000 + len(words)), 2000])
    assert 0 < texts <= 1


def test_unseen_word_is_spelled(spark):
    """An unseen word is not lifted by the floor of the word counts."""
    df = spark.createDataFrame([(1, "ab ab ab", True), (2, "qzqzqzqz", False), (3, "qzqzqzqzqzqzqzqz", False)], "row long, text string, use boolean")
    got = {r["row"]: r for r in lm_trie.train_and_score(df, F.col("use")).collect()}
    assert got[2]["score"] - got[3]["score"] > 8 * 2  # eight more unseen letters
    assert got[2]["score"] < got[2]["base_score"]
