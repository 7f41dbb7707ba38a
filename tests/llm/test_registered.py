"""The registered queries on the smallest tables, and the pipeline against its stages' brute force."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from laketide.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_quality import brute as counts
from tests.llm.test_substrings import brute as cut
from tools.check import TABLES, kind, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


def test_names():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_substrings", "benchmark_items", "byte_bpe"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    rows = got.collect()
    if name not in ORACLES:
        assert len(rows) == 200
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert {c: kind(t) for c, t in got.dtypes} == {d[0]: kind(str(d[1])) for d in result.description}
    assert rows_of(got.columns, rows) == rows_of(columns, result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    left = stages["quality_rules"](spark, docs, SF_DIR)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert rows and not any(counts(t)[5] for _, t in rows)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    passed = {i for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()) if i in good and not counts(t)[5]}
    assert len(passed - {i for i, _ in rows}) <= 0.05 * len(passed)  # clean documents stay
    roots = near(rows)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    removed = cut(rows, lambda t: t.encode(), corpus_pipeline.REPEATED, bytes)
    second = stages["repeated_substrings"](spark, stages["near_duplicates"](spark, left, SF_DIR), SF_DIR)
    got = {r["doc_id"]: r["text"] for r in second.collect()}
    assert second.columns == docs.columns and set(got) == {i for i, _ in rows}
    for (i, t), (_, gone, _, _) in zip(rows, removed, strict=True):
        assert got[i] == t if not gone else len(got[i].encode()) <= len(t.encode()) - gone
    hit = {p[0] for p in contained(list(got.items()), items)}
    final = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(final) == set(got) - hit
    assert all((n > 0) == bool(got[i]) for i, n in final.items())
