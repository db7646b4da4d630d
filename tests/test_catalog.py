"""Every catalogue query against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from lodestone.plans import catalog, fixtures, relations, requests, storage, texts  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalog.QUERIES | fixtures.QUERIES
SQL = catalog.SQL | fixtures.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return abs(a - b) < 1e-6 * max(1.0, abs(a)) if isinstance(a, float) and isinstance(b, float) else type(a) is type(b) and a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert len(got) == len(rows)
    assert all(same(x, y) for a, b in zip(got, rows, strict=True) for x, y in zip(a, b, strict=True))


def test_streamed_bucket_equals_batch(spark):
    rows = lambda q: sorted(map(tuple, q(spark, SF).select("event_id", "user_id", "allowed", "tokens").collect()))
    assert rows(fixtures.token_bucket_stream) == rows(catalog.token_bucket)
