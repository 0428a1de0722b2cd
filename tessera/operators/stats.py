"""Descriptive statistics of value columns (inventory F1-F30, F57-F61, D13-D15).

Every function takes a DataFrame, a value column and grouping columns, and is
one aggregation: partial sums on the map side, one shuffle of group keys.
Quantiles are exact and take two passes (``ordered.exact_quantiles``).
Null values are skipped; NaN is left out and counted on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import exact_quantiles, join_groups


def finite(x: Column) -> Column:
    """The value, or null for NaN."""
    return F.when(~F.isnan(x), x)


def guarded(value: Column, x: Column, otherwise: float = 0.0) -> Column:
    """``value`` unless the column is constant."""
    return F.when(F.min(x) < F.max(x), value).when(F.count(x) > 0, F.lit(otherwise))


def summary_columns(column: str) -> list[Column]:
    """The ten-field summary and its relatives as aggregates."""
    raw = F.col(column).cast("double")
    x = finite(raw)
    return [
        F.count(x).alias("n"),
        F.count_if(F.isnan(raw)).alias("n_nan"),
        F.sum(x).alias("total"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("var_samp"),
        F.var_pop(x).alias("var_pop"),
        F.stddev_samp(x).alias("std_samp"),
        F.stddev_pop(x).alias("std_pop"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        guarded(F.skewness(x), x).alias("skew"),
        guarded(F.kurtosis(x), x).alias("kurt"),
    ]


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*summary_columns(column))


def quantiles(df: DataFrame, column: str, probabilities: list[float], *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation, as one column for each."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie in [0, 1]")
    x = finite(F.col(column).cast("double"))
    groups = df.groupBy(*by).agg(F.count(x).alias("_n"))
    names = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    return with_quantiles(groups, exact_quantiles(df, x, probabilities, *by), *by).select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def with_quantiles(groups: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """Groups with the array ``q`` of their quantiles, null where a group has no values."""
    renamed = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], "q")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return groups.join(renamed, same, "left") if by else groups.join(F.broadcast(found), F.lit(True), "left")  # one row each


def norms(df: DataFrame, column: str, *by: str) -> DataFrame:
    x = finite(F.col(column).cast("double"))
    return df.groupBy(*by).agg(F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), F.max(F.abs(x)).alias("l_inf"))


def tails(df: DataFrame, column: str, *by: str) -> DataFrame:
    """p99, p99.9, p99.99 and the largest magnitude in standard deviations."""
    x = finite(F.col(column).cast("double"))
    spread = df.groupBy(*by).agg(F.max(F.abs(x)).alias("m"), F.stddev_pop(x).alias("s"))
    got = with_quantiles(spread, exact_quantiles(df, x, [0.99, 0.999, 0.9999], *by), *by)
    share = F.when(F.col("s") > 0, F.try_divide("m", "s")).otherwise(0.0)
    return got.select(*by, F.col("q")[0].alias("p99"), F.col("q")[1].alias("p99_9"), F.col("q")[2].alias("p99_99"), share.alias("max_over_std"))


def covariance(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Population covariance and Pearson correlation; the latter is null when a side hardly varies."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.covar_pop(x, y).alias("cov"), F.when(scale >= 1e-10, F.try_divide(F.covar_pop(x, y), scale)).alias("corr")
    )


def magnitudes(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Zero share, and counts and shares beyond three and five standard deviations.

    The moments of a group are aggregated first and joined back, so a hot
    group is not sorted or held anywhere.
    """
    x = F.col(column).cast("double")
    moments = df.groupBy(*by).agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"))
    joined = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))  # one row
    z = F.when(F.col("sd") < 1e-10, 0.0).otherwise(F.try_divide(F.abs(x - F.col("mu")), F.col("sd")))
    n = F.count(x)

    def share(c: Column) -> Column:
        return F.coalesce(F.try_divide(100.0 * c, n), F.lit(0.0))

    three, five, zero = F.count_if(z > 3), F.count_if(z > 5), F.count_if(x == 0)
    return joined.groupBy(*by).agg(
        n.alias("n"),
        three.alias("n_outliers"),
        five.alias("n_super"),
        share(three).alias("outlier_percent"),
        share(five).alias("super_percent"),
        share(zero).alias("zero_percent"),
    )


def density(df: DataFrame, column: str, epsilon: float, *by: str) -> DataFrame:
    """Share of values whose magnitude exceeds ``epsilon``."""
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.avg((F.abs(x) > epsilon).cast("double")), F.lit(0.0)).alias("density"))


def outliers(df: DataFrame, column: str, k: float, *by: str, centred: bool = True) -> DataFrame:
    """Rows further than ``k`` population deviations from the mean (from zero if not ``centred``)."""
    x = F.col(column).cast("double")
    moments = df.groupBy(*by).agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"), F.count(x).alias("_n"))
    joined = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))
    far = F.abs(x - F.col("_mu")) if centred else F.abs(x)
    return joined.filter((F.col("_n") >= 2) & (F.col("_sd") >= 1e-10) & (far > k * F.col("_sd"))).drop("_mu", "_sd", "_n")


def outliers_by_quantile(df: DataFrame, column: str, q: float, *by: str, compat: bool = False) -> DataFrame:
    """Rows whose magnitude exceeds the magnitudes' quantile ``q`` (``compat``: the signed values' quantile)."""
    if not 0.5 < q < 1:
        raise ValueError("q lies in (0.5, 1)")
    x = F.col(column).cast("double")
    limit = exact_quantiles(df, x if compat else F.abs(x), [q], *by).select(*by, F.col("q")[0].alias("_limit"))
    joined = join_groups(df, limit, *by) if by else df.crossJoin(F.broadcast(limit))
    return joined.filter(F.abs(x) > F.col("_limit")).drop("_limit")
