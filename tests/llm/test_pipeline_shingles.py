import corpus_pipeline
from laketide.llm import near_dedup


def test_five_words(spark):
    """Texts alike by shingles of four words (79 of 95) but not of five (76 of 96) both stay; the op5 query keeps its four."""
    words = [f"w{i}" for i in range(90)]
    changed = [f"other{i}" if i in (30, 60) else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words))], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}
    assert {r["component_id"] for r in near_dedup.groups(df).collect()} == {1}
