"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from laketide.plans import catalog
from tools.check import TABLES, kind, rows_of

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_names():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert len(QUERIES) > 190 and len(QUERIES) - len(ORACLES) <= 4


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert {c: kind(t) for c, t in df.dtypes} == {d[0]: kind(str(d[1])) for d in result.description}
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())
