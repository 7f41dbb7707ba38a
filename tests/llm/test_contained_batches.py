import random

import numpy as np
import pyarrow as pa

from laketide.llm import blocks, common, decontaminate
from laketide.llm.common import BATCH_BYTES, CLEANUP, stored
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import brute


def test_slices_hold_every_row_once():
    texts = ["a" * 30, None, "", "b" * 200, "c", "é" * 20, None, "d" * 99, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["doc_id", "text"])
    for whole in (batch, batch.slice(2), batch.slice(1, 5), batch.slice(9)):
        for limit in (1, 40, 100, 1000):
            parts = list(blocks.slices(whole, 1, limit))
            assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
            assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= limit for p in parts)


def test_few_texts_of_a_large_batch_are_held(monkeypatch):
    """A batch of 8 MB: texts were all turned into Python objects at once."""
    rng = random.Random(3)
    texts = [prose(rng, 900) for _ in range(40)] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "mark", "text"])
    held = []
    monkeypatch.setattr(decontaminate, "text_bytes", lambda column, lower=False: held.append(sum(map(len, got := blocks.text_bytes(column, lower)))) or got)
    none = np.zeros(1 << 21, dtype=np.uint8)
    list(decontaminate._emit_hits(5, [3], none, none)(iter([batch])))
    assert sum(held) == sum(map(len, texts)) > 3 * decontaminate.BATCH
    assert max(held) <= decontaminate.BATCH


def test_documents_travel_in_bounded_batches(spark, monkeypatch):
    """The batches of documents that reach Python; by default they hold 64 MB."""
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(8)]
    docs = [(i, prose(rng, 400) + " " + items[i % 8][1]) for i in range(60)] + [(60, prose(rng, 9000)), (61, None)]
    limit = 16000
    monkeypatch.setattr(decontaminate, "BATCH", limit)
    seen = spark.sparkContext.accumulator(0)
    emit = decontaminate._emit_hits

    def counted(*given):
        work = emit(*given)

        def each(batches):
            for batch in batches:
                seen.add(1)
                yield from work(iter([batch]))

        return each

    monkeypatch.setattr(decontaminate, "_emit_hits", counted)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in decontaminate.pairs(d, b).collect()}
    assert found == brute(docs, items) and len(found) >= 60
    assert seen.value >= sum(len((t or "").encode()) for _, t in docs) // (4 * limit) > 1


def test_settings_of_a_write_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in (BATCH_BYTES, CLEANUP)}
    assert stored(spark.range(5).toDF("n"), "test", 1 << 20).count() == 5
    assert {k: spark.conf.get(k, None) for k in before} == before
    spark.conf.set(common.BATCH_BYTES, "5000000b")
    try:
        stored(spark.range(5).toDF("n"), "test", 1 << 20)
        assert spark.conf.get(common.BATCH_BYTES) == "5000000b"
    finally:
        spark.conf.unset(common.BATCH_BYTES)
    assert {k: spark.conf.get(k, None) for k in before} == before
