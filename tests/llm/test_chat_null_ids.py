from pyspark.sql import functions as F

from laketide.llm import chat_collapse


def test_many_rows_without_id(spark, monkeypatch):
    """Rows without an id share few turn numbers: no part holds more than a chunk of them, and none is lost."""
    monkeypatch.setattr(chat_collapse, "RANGE_ROWS", 500, raising=False)
    n, chunk = 3000, 256
    turn = F.when(F.col("id") % 12 == 11, None).otherwise((F.col("id") % 12).cast("int"))
    lone = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), turn.alias("turn"), F.lit("user").alias("role"), F.format_string("t%05d", "id").alias("text"))
    other = spark.createDataFrame([(1, 0, "user", "a"), (1, 300, "user", "b")], lone.schema)
    got = chat_collapse.render(lone.unionAll(other).unionAll(lone.limit(10)), chunk).collect()
    parts = sorted((r["part"], r["rendered"]) for r in got if r["conv_id"] is None)
    assert [p for p, _ in parts] == list(range(-(-n // chunk)))
    assert max(x.count("<|im_start|>") for _, x in parts) <= chunk
    order = sorted(range(n), key=lambda i: (i % 12 if i % 12 != 11 else -1, i))
    assert "".join(x for _, x in parts) == "".join(f"<|im_start|>user\nt{i:05d}<|im_end|>\n" for i in order)
    assert {r["n_turns"] for r in got if r["conv_id"] is None} == {n}
    assert sorted(r["part"] for r in got if r["conv_id"] == 1) == [0, 1]
