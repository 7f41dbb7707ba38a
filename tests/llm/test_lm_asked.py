import pathlib

import pyarrow as pa

from laketide.llm import lm_trie
from laketide.session import shared_dir


def test_small_questions_are_looked_up_together(monkeypatch):
    """The questions of many blocks share searches, and any batch gives the same answers; before, each block had its own."""
    texts = [f"one two {i} three" for i in range(12)]
    sent = pa.concat_tables([lm_trie._emit(4, 1)(pa.table({"block": [i], "row": [i], "train": [i % 3 > 0], "text": [t]})) for i, t in enumerate(texts)])
    model = lm_trie._model(4)(sent.append_column("part", pa.array([0] * len(sent))))
    asked = sent.select(["shard", "block", "grams", "words"])
    calls, plain = [], lm_trie.Trie.find
    monkeypatch.setattr(lm_trie.Trie, "find", lambda *a: calls.append(1) or plain(*a))
    want = lm_trie._answer(4)(asked, model)
    assert len(calls) == 4
    monkeypatch.setattr(lm_trie, "ASKED", 1)
    assert lm_trie._answer(4)(asked, model).equals(want) and len(calls) == 4 + 4 * 12
    assert want.column("of").to_pylist() == list(range(12))


def test_spent_tables_are_deleted(spark):
    """N-grams sent and the model take no disk while blocks are scored."""
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "row long, text string")
    base = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "laketide"
    before = set(base.glob("llm-lm-*")) if base.exists() else set()
    out = lm_trie.train_and_score(docs, docs["row"] % 4 != 0, block_bytes=40)
    assert {p.name.split("-")[2] for p in set(base.glob("llm-lm-*")) - before if any(p.glob("*.parquet"))} == {"answers"}
    assert out.count() == 20
