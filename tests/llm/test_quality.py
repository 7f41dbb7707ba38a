from collections import Counter

from laketide.llm import quality_llr


def brute(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed


def test_counts(docs, corpus, spark):
    odd = [(200, "a b\n\na b\nc\x0bd\n a b\n" + "# x | <y> $$ " * 30), (201, "\n\n"), (202, "東京 " * 60)]
    df = docs.select("doc_id", "text", "kept").unionAll(spark.createDataFrame([(*r, True) for r in odd], "doc_id long, text string, kept boolean"))
    got = quality_llr.judge(df, [0.0] * 16)
    assert got.columns == ["doc_id", "text", "kept", "quality"]
    rows = sorted(((r["doc_id"], r["text"], *r["quality"][:6]) for r in got.collect()), key=repr)
    assert rows == sorted(((*r, *brute(r[1])) for r in [*corpus, *odd]), key=repr)
    assert all(r["quality"]["kept"] != r["quality"]["base_failed"] for r in got.collect())
    # a filter on the verdict, as in the pipeline, changes nothing
    kept = got.where("quality.kept").count()
    assert kept == sum(not brute(t)[5] for _, t in [*corpus, *odd])


def test_ratio_separates(spark):
    good = [(i, " ".join(f"fine{(i * 7 + j) % 90}" for j in range(80))) for i in range(40)]
    bad = [(100 + i, " ".join(f"junk{(i * 5 + j) % 90}" for j in range(80))) for i in range(40)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(1, 1, 0), (None, 1, 0), (100, 1, 1), (101, 0, 0), (102, 1, 0), (102, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["doc_id"] for r in quality_llr.good_ids(labels).orderBy("doc_id").collect()] == list(range(20))
    weights = quality_llr.learn_weights(df, labels, buckets=1024)  # few texts: fewer bins than added counts
    kept = {r["doc_id"] for r in quality_llr.judge(df, weights).where("quality.kept").collect()}
    assert kept == set(range(40))
    assert quality_llr.learn_weights(df, labels.where("false")) == [0.0] * quality_llr.BUCKETS


def test_no_rows(empty):
    assert quality_llr.judge(empty, [0.0] * 4).count() == 0
