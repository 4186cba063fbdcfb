"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lexaudit.plans.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(plain(r[k])) for k in at) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert table(got.columns, got.collect()) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
    assert entry.entry(spark).count() > 0
