"""Linear algebra and merges over all rows and columns of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import catalog, generate, linalg, numeric
from tessera.plans.queries import Query, rounded
from tessera.plans.tables import CATALOGUE, WHOLE_MATRIX, catalogue, matrix

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("i", F.col("i").cast("bigint")).withColumn("j", F.col("j").cast("bigint"))


@query(f"WITH {WHOLE_MATRIX} SELECT a.label, a.col AS i, b.col AS j, round(sum(a.val * b.val), 5) AS val FROM matrix a JOIN matrix b ON a.label = b.label AND a.row = b.row AND a.col <= b.col GROUP BY 1, 2, 3")
def j_gram_whole(s, d):
    """J1 (Gram matrix)."""
    return _pairs(linalg.gram(matrix(s, d), "label")).withColumn("val", F.round("val", 5))


@query(f"WITH {WHOLE_MATRIX} SELECT a.col AS i, b.col AS j, count(*) AS n, round(corr(a.val, b.val), 6) AS corr FROM matrix a JOIN matrix b ON a.row = b.row AND a.col <= b.col GROUP BY 1, 2")
def j_correlation_whole(s, d):
    """E17, E18, F25."""
    return _pairs(linalg.correlation_matrix(matrix(s, d))).withColumn("corr", F.round("corr", 6))


@query(f"""
    WITH {WHOLE_MATRIX}, c AS (SELECT a.label, a.col AS i, b.col AS j, corr(a.val, b.val) AS r FROM matrix a JOIN matrix b ON a.label = b.label AND a.row = b.row AND a.col < b.col GROUP BY 1, 2, 3)
    SELECT label, round(avg(abs(r)), 6) AS mean_abs, round(max(abs(r)), 6) AS max_abs FROM c GROUP BY 1
""")
def j_off_diagonal_whole(s, d):
    """F24."""
    g = linalg.off_diagonal(linalg.correlation_matrix(matrix(s, d), "label"), "label")
    return rounded(g, 6).withColumn("label", F.col("label").cast("int"))


@query(f"WITH {WHOLE_MATRIX} SELECT row, col, round(CASE WHEN abs(row - col) <= 3 THEN CASE WHEN row >= 5 THEN val * 0.1 ELSE val END ELSE 0 END, 6) AS val FROM matrix")
def l_mask_whole(s, d):
    """A band mask, and damped rows."""
    m = generate.apply_mask(matrix(s, d), generate.sparse_mask("diagonal_band", 0, 0, 3))
    return generate.damp_rows(m, 5).select("row", F.col("col").cast("bigint").alias("col"), F.round("val", 6).alias("val"))


@query(f"""
    WITH {WHOLE_MATRIX}, f AS (SELECT i // 64 AS row, i % 64 AS col, ((i // 64 * 7 + i % 64 * 3) % 11 - 5) / 10.0 AS val FROM range(256) t(i))
    SELECT a.row, f.row AS col, round(0.5 * sum(a.val * f.val), 6) AS val FROM matrix a JOIN f ON a.col = f.col GROUP BY 1, 2
""")
def j_product_whole(s, d):
    """Product of the whole long matrix with a fixed factor of 4 rows."""
    i = F.col("id")
    row, col = F.floor(i / 64), i % 64
    factor = s.range(256).select(row.alias("row"), col.alias("col"), (((row * 7 + col * 3) % 11 - 5) / 10.0).alias("val"))
    return linalg.product(matrix(s, d).select("row", "col", "val"), F.broadcast(factor), 0.5).withColumn("val", F.round("val", 6))


@query(f"""
    WITH {WHOLE_MATRIX}, a AS (SELECT row, col, exp(val) AS v FROM matrix),
    b AS (SELECT row, col, v / sum(v) OVER (PARTITION BY row) AS v FROM a), c AS (SELECT row, col, v / sum(v) OVER (PARTITION BY col) AS v FROM b)
    SELECT row, col, round(v, 6) AS val FROM c
""")
def r_sinkhorn_whole(s, d):
    """One round of row and column scaling."""
    m = matrix(s, d).select("row", "col", F.exp("val").alias("val"))
    return numeric.sinkhorn(m, 1).select("row", F.col("col").cast("bigint").alias("col"), F.round("val", 6).alias("val"))


@query(f"""
    WITH {CATALOGUE}, x AS (SELECT name, dtype, 0 AS side FROM catalogue UNION ALL SELECT name, 'X' || dtype, 1 FROM catalogue WHERE p_partkey % 3 = 0)
    SELECT name, arg_max(dtype, side) AS dtype FROM x GROUP BY 1
""")
def i_merge_whole(s, d):
    """The whole catalogue with a part of it overridden."""
    c = catalogue(s, d)
    k = F.regexp_extract("name", r"\.([0-9]+)\.weight$", 1).cast("bigint")
    return catalog.merge_by_key(c, c.filter(k % 3 == 0).withColumn("dtype", F.concat(F.lit("X"), "dtype")), "name", "dtype")
