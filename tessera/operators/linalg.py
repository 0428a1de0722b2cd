"""Matrices as long tables (row, col, val) (inventory E17, E18, F24, F25, J1-J20).

Products are joins and sums.  Moments of column pairs are matrix products of
each task's rows, merged by sums; spectra of the small Gram matrix use numpy on
one group each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _wide(matrix: DataFrame, *by: str) -> DataFrame:
    """One row for each matrix row: by, cols, vals (arrays in order of col; nulls left out)."""
    rows = matrix.filter("val is not null").groupBy(*by, "row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("v"))
    return rows.select(*by, F.col("v.col").cast("array<long>").alias("cols"), F.col("v.val").cast("array<double>").alias("vals"))


class _Moments:
    """Sums over the rows of one group for all pairs of columns, as matrix products.

    Values are taken from the first value seen in their column, so that sums
    of squares stay exact where means are large.
    """

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.base = np.zeros(0)
        self.n = self.sx = self.sxx = self.sxy = np.zeros((0, 0))

    def _grow(self, cols: np.ndarray, vals: np.ndarray) -> None:
        new, first = np.unique(cols, return_index=True)
        fresh = [(int(c), float(vals[i])) for c, i in zip(new, first) if int(c) not in self.place]
        if fresh:
            for c, v in fresh:
                self.place[c] = len(self.place)
            self.base = np.concatenate([self.base, [v for _, v in fresh]])
            d, old = len(self.place), len(self.n)
            for k in ("n", "sx", "sxx", "sxy"):
                m = np.zeros((d, d))
                m[:old, :old] = getattr(self, k)
                setattr(self, k, m)

    def add(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_rows: int) -> None:
        self._grow(cols, vals)
        at = np.array([self.place[int(c)] for c in cols], dtype=int)
        x, have = np.zeros((n_rows, len(self.place))), np.zeros((n_rows, len(self.place)))
        x[rows, at] = vals - self.base[at]
        have[rows, at] = 1
        self.n += have.T @ have
        self.sx += x.T @ have  # sum of the first column's values where both are there
        self.sxx += (x * x).T @ have
        self.sxy += x.T @ x

    def rows(self) -> pd.DataFrame:
        """i, j (i <= j), n, means and centred sums of both columns."""
        cols = np.array(list(self.place))
        i, j = np.nonzero((cols[:, None] <= cols[None]) & (self.n > 0))
        n, sx, sy = self.n[i, j], self.sx[i, j], self.sx[j, i]
        return pd.DataFrame(
            {
                "i": cols[i], "j": cols[j], "n": n, "mx": sx / n + self.base[i], "my": sy / n + self.base[j],
                "cxx": self.sxx[i, j] - sx * sx / n, "cyy": self.sxx[j, i] - sy * sy / n, "cxy": self.sxy[i, j] - sx * sy / n,
            }
        )


def pair_moments(matrix: DataFrame, *by: str, groups: int = 64) -> DataFrame:
    """by, i, j (i <= j), n, mx, my, cxx, cyy, cxy: moments of all pairs of columns over the rows that have both.

    Each task adds up its rows by matrix products and gives one row a pair;
    parts are merged with the formula for pooled moments.  ``groups`` bounds
    the groups that a task holds at a time.
    """
    wide = _wide(matrix, *by)
    kinds = dict(wide.dtypes)

    def run(batches):
        held: dict[tuple, _Moments] = {}

        def out(key, m):
            return m.rows().assign(**dict(zip(by, key)))[[*by, "i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"]]

        for pdf in batches:
            parts = pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]
            for key, part in parts:
                key = key if isinstance(key, tuple) else (key,)
                size = part["cols"].map(len).to_numpy()
                held.setdefault(key, _Moments()).add(np.repeat(np.arange(len(part)), size), np.concatenate(part["cols"].to_numpy()), np.concatenate(part["vals"].to_numpy()), len(part))
                if len(held) > groups:
                    first = next(iter(held))
                    yield out(first, held.pop(first))
        for key, m in held.items():
            yield out(key, m)

    fields = [f"{c} {kinds[c]}" for c in by] + ["i long, j long, n double, mx double, my double, cxx double, cyy double, cxy double"]
    parts = wide.mapInPandas(run, ", ".join(fields))
    pair = W.partitionBy(*by, "i", "j")  # one row a task and pair

    def pooled(mean: str) -> Column:
        return F.sum(F.col("n") * F.col(mean)).over(pair) / F.sum("n").over(pair)

    around = parts.withColumn("_x", pooled("mx")).withColumn("_y", pooled("my"))

    def total(own: str, a: str, b: str) -> Column:
        gaps = {"mx": F.col("mx") - F.col("_x"), "my": F.col("my") - F.col("_y")}
        return F.sum(F.col(own) + F.col("n") * gaps[a] * gaps[b]).alias(own)

    return around.groupBy(*by, "i", "j").agg(
        F.sum("n").cast("bigint").alias("n"), F.max("_x").alias("mx"), F.max("_y").alias("my"), total("cxx", "mx", "mx"), total("cyy", "my", "my"), total("cxy", "mx", "my")
    )


def gram(matrix: DataFrame, *by: str) -> DataFrame:
    """A'A: by, i, j (i <= j), val."""
    return pair_moments(matrix, *by).select(*by, "i", "j", (F.col("cxy") + F.col("n") * F.col("mx") * F.col("my")).alias("val"))


def correlation_matrix(matrix: DataFrame, *by: str) -> DataFrame:
    """by, i, j (i <= j), n, corr of the columns over common rows; null when a column hardly varies."""
    m = pair_moments(matrix, *by)
    scale = F.sqrt(F.greatest("cxx", F.lit(0.0)) / F.col("n")) * F.sqrt(F.greatest("cyy", F.lit(0.0)) / F.col("n"))
    return m.select(*by, "i", "j", "n", F.when(scale >= 1e-10, F.try_divide(F.col("cxy") / F.col("n"), scale)).alias("corr"))


def off_diagonal(correlations: DataFrame, *by: str) -> DataFrame:
    """Mean and largest magnitude off the diagonal."""
    return correlations.filter("i <> j").groupBy(*by).agg(F.avg(F.abs("corr")).alias("mean_abs"), F.max(F.abs("corr")).alias("max_abs"))


def compare_correlations(correlations: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Issues of pairs (i, j, expected) whose correlation is off by more than the tolerance."""
    off = F.abs(F.col("corr") - F.col("expected"))
    severity = F.when(F.col("corr").isNull(), "ERROR").when(off > 2 * tolerance, "ERROR").when(off > tolerance, "WARNING")
    return correlations.join(expected, ["i", "j"]).withColumn("severity", severity).filter("severity is not null")


def product(u: DataFrame, v: DataFrame, alpha: float = 1.0, rows: tuple[int, int] | None = None) -> DataFrame:
    """alpha * U V' of two long tables with ``col`` as the common index, or of a block of rows."""
    if rows:
        u = u.filter(F.col("row").between(rows[0], rows[1] - 1))
    right = v.select(F.col("row").alias("_j"), "col", F.col("val").alias("_w"))
    return u.join(right, "col").groupBy("row", F.col("_j").alias("col")).agg((alpha * F.sum(F.col("val") * F.col("_w"))).alias("val"))


def singular_values(matrix: DataFrame, *by: str) -> DataFrame:
    """by, sigma: exact singular values as square roots of the Gram matrix's eigenvalues.

    The Gram matrix is as large as the columns squared, whatever the rows.
    """

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        index = {c: k for k, c in enumerate(sorted(set(pdf["i"]) | set(pdf["j"])))}
        g = np.zeros((len(index), len(index)))
        a, b = pdf["i"].map(index), pdf["j"].map(index)
        g[a, b] = g[b, a] = pdf["val"]
        sigma = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(sigma) for c in by}, "sigma": sigma})

    g = gram(matrix, *by)
    fields = [f"{c} {dict(g.dtypes)[c]}" for c in by] + ["sigma double"]
    return g.groupBy(*by).applyInPandas(spectrum, ", ".join(fields))


def cholesky(covariance: DataFrame, *by: str) -> DataFrame:
    """Lower factor of symmetric positive definite matrices; raises otherwise."""

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["row"].max()) + 1
        s = np.zeros((n, n))
        s[pdf["row"], pdf["col"]] = pdf["val"]
        if not np.allclose(s, s.T, atol=1e-9):
            raise ValueError("the matrix is not symmetric")
        low = np.linalg.cholesky(s)
        i, j = np.nonzero(np.tril(np.ones((n, n))))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "row": i, "col": j, "val": low[i, j]})

    fields = [f"{c} {dict(covariance.dtypes)[c]}" for c in by] + ["row long, col long, val double"]
    return covariance.groupBy(*by).applyInPandas(factor, ", ".join(fields))


def reconstruction_error(factor: DataFrame, covariance: DataFrame) -> DataFrame:
    """Frobenius norm of L L' - S: one row, ``error``."""
    back = product(factor, factor).withColumnRenamed("val", "_b")
    both = covariance.join(back, ["row", "col"], "full_outer")
    gap = F.coalesce("val", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return both.agg(F.sqrt(F.sum(gap * gap)).alias("error"))


def covariance(matrix: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The lower factor of a matrix that is square, symmetric and positive definite; raises for any other."""
    shape = matrix.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")).first()
    if shape["n"] == 0 or shape["r"] != shape["c"] or shape["n"] != (shape["r"] + 1) ** 2:
        raise ValueError("the matrix is not square")
    factor = cholesky(matrix)
    if reconstruction_error(factor, matrix).first()["error"] > tolerance * shape["norm"]:
        raise ValueError("the factor does not give the matrix back")
    return factor


def diagonal(variances: DataFrame) -> DataFrame:
    """row, col, val, root: diagonal covariance of variances (i, variance) and its factor; others than positive ones raise."""
    v = F.col("variance")
    good = F.when((v > 0) & (v < float("inf")), v).otherwise(F.raise_error(F.lit("a variance is not positive")))
    return variances.select(F.col("i").alias("row"), F.col("i").alias("col"), good.cast("double").alias("val"), F.sqrt(good).alias("root"))


def pairs_in_order(dimension: int, k: Column) -> tuple[Column, Column]:
    """Row and column of the k-th cell above the diagonal, row by row."""
    # the largest i with i * (2 n - i - 1) / 2 <= k; the root is corrected by whole numbers
    guess = F.floor((2 * dimension - 1 - F.sqrt(F.pow(F.lit(2.0 * dimension - 1), 2) - 8 * k)) / 2).cast("long")

    def before(i: Column) -> Column:
        return F.floor(i * (2 * dimension - i - 1) / 2)

    i = F.when(before(guess + 1) <= k, guess + 1).when(before(guess) > k, guess - 1).otherwise(guess)
    return i, k - before(i) + i + 1


def pairwise_cells(correlations: DataFrame, dimension: int) -> DataFrame:
    """row, col, val of the correlation matrix with the cells (k, rho) of its upper triangle."""
    i, j = pairs_in_order(dimension, F.col("k"))
    rho = F.when(F.col("rho").between(-1.0, 1.0), F.col("rho").cast("double")).otherwise(F.raise_error(F.lit("a correlation is not in [-1, 1]")))
    upper = correlations.select(i.alias("i"), j.alias("j"), rho.alias("val"))
    both = upper.select(F.explode(F.array(F.struct(F.col("i").alias("row"), F.col("j").alias("col")), F.struct(F.col("j").alias("row"), F.col("i").alias("col")))).alias("c"), "val")
    ones = correlations.sparkSession.range(dimension).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))
    return both.select("c.row", "c.col", "val").unionAll(ones)


def pairwise(spark, dimension: int, rhos: list[float]) -> DataFrame:
    """The same from a list."""
    if len(rhos) != dimension * (dimension - 1) // 2:
        raise ValueError(f"{dimension} columns have {dimension * (dimension - 1) // 2} correlations, not {len(rhos)}")
    return pairwise_cells(spark.createDataFrame([(k, float(r)) for k, r in enumerate(rhos)], "k long, rho double"), dimension)


def equicorrelation(spark, sizes: list[int], rhos: list[float]) -> DataFrame:
    """Block-diagonal correlation matrix (row, col, val), one block for each size."""
    for d, rho in zip(sizes, rhos, strict=True):
        if not (d == 1 or -1 / (d - 1) <= rho <= 1):
            raise ValueError("rho is out of range for its block")
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    blocks = spark.createDataFrame(list(zip(starts, sizes, rhos)), "start long, d long, rho double")
    row = F.explode(F.sequence(F.lit(0), F.col("d") - 1))
    cells = blocks.withColumn("a", row).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    return cells.select((F.col("start") + F.col("a")).alias("row"), (F.col("start") + F.col("b")).alias("col"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("rho")).alias("val"))


def broadcastable(a: Column, b: Column) -> Column:
    """Whether two shapes have one rank and dimensions that are equal or 1."""
    bad = F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: (x["a"] != x["b"]) & (x["a"] != 1) & (x["b"] != 1))
    return (F.size(a) == F.size(b)) & ~bad
