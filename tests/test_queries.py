"""Every core query with SQL gives the same rows in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, db, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = db.sql(core.SQL[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    expected = sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
    assert got == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs_without_sql(spark, name):
    df = core.QUERIES[name](spark, DATA)
    assert df.count() > 0
