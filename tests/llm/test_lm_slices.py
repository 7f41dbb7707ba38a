import numpy as np
import pyarrow as pa

from laketide.llm import elias_fano, lm_trie


def test_distinct_and_numbered():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 5000):
        x = rng.integers(0, 900, n).astype(np.uint64)
        want, back = np.unique(x, return_inverse=True)
        assert np.array_equal(elias_fano.distinct(x), want)
        values, place = lm_trie._numbered(x)
        assert np.array_equal(values, want) and np.array_equal(place, back)


def test_texts_are_cut_once_for_their_scores(monkeypatch):
    """Scoring a block cuts and sorts each slice of it once (before: once for the questions, once for the sums)."""
    texts = ["one two three", "", "two two " * 30, "four"]
    docs = pa.table({"block": [0] * 4, "row": [1, 2, 3, 4], "train": [True, True, True, False], "text": texts})
    sent = lm_trie._emit(4, 1)(docs)
    model = lm_trie._model(4)(sent.append_column("part", pa.array([0])))
    answers = lm_trie._answer(4)(sent, model)
    cuts, plain = [], lm_trie.Grams
    monkeypatch.setattr(lm_trie, "SLICE_BYTES", 64)
    monkeypatch.setattr(lm_trie, "Grams", lambda part, order: cuts.append(len(part)) or plain(part, order))
    out = lm_trie._score(4, 1, 70, 4)(docs, answers)
    assert sum(cuts) == 4 and len(cuts) > 1
    assert out.column("row").to_pylist() == [1, 2, 3, 4] and out.column("n_tokens").to_pylist() == [4, 1, 61, 2]
    assert out.column("n_known").to_pylist() == [4, 1, 61, 1]
