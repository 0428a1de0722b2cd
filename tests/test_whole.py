"""Queries over whole tables: same rows as their SQL, all columns and rows, plans without cartesian products."""

import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.operators import numeric
from tessera.plans import queries as core
from tessera.plans import whole
from test_queries import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
PYTHON = {"j_gram_whole", "j_correlation_whole", "j_off_diagonal_whole"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(whole.QUERIES))
def test_same_rows_as_sql(spark, db, name):
    assert __spark_entry__.oracle_sql()[name] == whole.SQL[name]
    df = __spark_entry__.queries()[name](spark, DATA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and bool(re.search("Python|Pandas|ArrowEval", text)) == (name in PYTHON)
    columns = sorted(df.columns)
    relation = db.sql(whole.SQL[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


def test_all_columns_are_there(spark, db):
    vectors = db.sql("SELECT label, embedding FROM embeddings").fetchall()
    labels, width = {v[0] for v in vectors}, len(vectors[0][1])
    got = {}
    for r in core.QUERIES["j_singular_values"](spark, DATA).collect():
        got.setdefault(r["label"], []).append(r["sigma"])
    assert set(got) == labels
    for label, sigma in got.items():
        x = np.array([v for g, v in vectors if g == label], dtype=float)
        expected = np.zeros(width)
        expected[: min(x.shape)] = np.linalg.svd(x, compute_uv=False)
        assert np.allclose(sorted(sigma, reverse=True), expected, atol=1e-5)
    assert whole.QUERIES["j_correlation_whole"](spark, DATA).count() == width * (width + 1) // 2
    assert whole.QUERIES["j_gram_whole"](spark, DATA).count() == len(labels) * width * (width + 1) // 2
    assert whole.QUERIES["l_mask_whole"](spark, DATA).count() == len(vectors) * width


def test_product_has_every_row(spark, db):
    x = dict(db.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    f = np.array([[((r * 7 + c * 3) % 11 - 5) / 10 for c in range(64)] for r in range(4)])
    got = {(r["row"], r["col"]): r["val"] for r in whole.QUERIES["j_product_whole"](spark, DATA).collect()}
    assert set(got) == {(i, k) for i in x for k in range(4)}
    assert all(abs(got[i, k] - 0.5 * f[k] @ np.array(v, dtype=float)) < 2e-6 for i, v in x.items() for k in range(4))


def test_sinkhorn_scales_every_row_and_never_gathers_a_column(spark, db):
    rows = {r[0] for r in db.sql("SELECT vec_id FROM embeddings").fetchall()}
    df = whole.QUERIES["r_sinkhorn_whole"](spark, DATA)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    cells = df.collect()
    assert {r["row"] for r in cells} == rows and len(cells) == len(rows) * 64
    x = np.random.default_rng(3).random((7, 5)) + 0.1
    m = spark.createDataFrame([(None if g else 1, i, j, float(x[i, j]) * (1 + g)) for g in (0, 1) for i in range(7) for j in range(5)], "g int, row long, col long, val double")
    for _ in range(3):
        x = x / x.sum(1, keepdims=True)
        x = x / x.sum(0, keepdims=True)
    got = numeric.sinkhorn(m, 3, "g").collect()
    assert len(got) == 70 and all(abs(r["val"] - x[r["row"], r["col"]]) < 1e-9 for r in got)


def test_merge_has_every_tensor(spark, db):
    got = {r["name"] for r in whole.QUERIES["i_merge_whole"](spark, DATA).collect()}
    assert len(got) == db.sql("SELECT count(*) FROM part").fetchall()[0][0]
