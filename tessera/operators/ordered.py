"""Analytics on ordered values: empirical distributions, fits, tests, running sums (inventory G1-G21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.special import normal_cdf, student_t_cdf


def ecdf_at(df: DataFrame, column: str, x: float, *by: str) -> DataFrame:
    """Share of values up to ``x``."""
    v = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.avg((v <= x).cast("double")), F.lit(0.0)).alias("share"))


def value_bucket(x: Column, bits: int = 12) -> Column:
    """A whole number that rises with ``x``: its sign, power of two and leading mantissa bits.

    It depends on the value alone, so that long orders can be cut into many
    tasks without sampling and alike in every run.
    """
    size = F.abs(x)
    power = F.floor(F.log2(F.when(size > 0, size)))
    step = power * (1 << bits) + F.floor(size / F.pow(F.lit(2.0), power) * (1 << bits)) - (1 << bits) + (1 << (bits + 11))
    step = F.when(size == float("inf"), 1 << (bits + 13)).otherwise(step)
    return F.when(size == 0, 0).when(x < 0, -step).otherwise(step).cast("bigint")


def join_groups(rows: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """Inner join by columns of which null is a value like any other."""
    renamed = other.select(*[F.col(c).alias(f"_by_{c}" if c in by else c) for c in other.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(renamed, same).drop(*[f"_by_{c}" for c in by])


def _bucket_offsets(rows: DataFrame, number: Column, *by: str) -> DataFrame:
    """For each bucket of a group the sum of ``number`` in it (``_s``), in lower ones (``_offset``) and in all (``n``)."""
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(number).alias("_s"))
    keys = list(by) or [F.lit(1)]
    below = F.sum("_s").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_s").over(W.partitionBy(*keys))
    return sums.select(*by, "_bucket", "_s", F.coalesce(below, F.lit(0)).alias("_offset"), total.alias("n"))


def with_offsets(counted: DataFrame, number: Column, *by: str) -> DataFrame:
    """Adds to rows with ``_bucket`` the sum of ``number`` in lower buckets (``_offset``) and in all (``n``) of their group."""
    return join_groups(counted, _bucket_offsets(counted, number, *by).drop("_s"), *by, "_bucket")


def exact_quantiles(df: DataFrame, x: Column, probabilities: list[float], *by: str) -> DataFrame:
    """``q``, the array of exact quantiles with linear interpolation of every group that has values.

    Values are counted by buckets of near values first; only the buckets that
    hold a wanted rank are then ordered.  No task sees a group's values at
    once, and what is shuffled are counts and those few buckets.
    """
    rows = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x")).withColumn("_bucket", value_bucket(F.col("_x")))
    places = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    ranks = [f(place).cast("bigint") for place in places for f in (F.floor, F.ceil)]
    wanted = F.exists(F.array(*ranks), lambda r: (r >= F.col("_offset")) & (r < F.col("_offset") + F.col("_s")))
    near = join_groups(rows, _bucket_offsets(rows, F.lit(1), *by).filter(wanted).drop("_s"), *by, "_bucket")
    counted = near.groupBy(*by, "_bucket", "_x", "_offset", "n").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by, "_bucket").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")
    ranked = counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))
    held = [F.max(F.when((F.col("_before") <= r) & (r < F.col("_upto")), F.col("_x"))) for r in ranks]
    got = ranked.groupBy(*by, "n").agg(*[h.alias(f"_h{i}") for i, h in enumerate(held)])
    between = []
    for i, place in enumerate(places):
        low, high, share = F.col(f"_h{2 * i}"), F.col(f"_h{2 * i + 1}"), place - F.floor(place)
        between.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share))
    return got.select(*by, F.array(*between).alias("q"))


def ranked_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Distinct values with the numbers of smaller values (``before``) and of values up to them (``upto``).

    Values are counted before they are ordered, and a group's order is cut
    into buckets of near values, so that a task sorts one bucket's distinct
    values and never a whole group.
    """
    v = F.col(column).cast("double")
    counted = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("x")).agg(F.count("*").alias("c"))
    placed = with_offsets(counted.withColumn("_bucket", value_bucket(F.col("x"))), F.col("c"), *by)
    upto = F.sum("c").over(W.partitionBy(*by, "_bucket").orderBy("x").rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")
    return placed.select(*by, "x", "c", upto.alias("upto"), (upto - F.col("c")).alias("before"), "n")


def ks(ranked: DataFrame, cdf: Column, *by: str, compat: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance of ``x`` against ``cdf``: n, d.

    The default is two-sided; ``compat`` takes only i / n - F(x) for every rank.
    """
    high, low = F.abs(F.col("upto") / F.col("n") - cdf), F.abs(F.col("before") / F.col("n") - cdf)
    first = F.abs((F.col("before") + 1) / F.col("n") - cdf)
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.greatest(high, first if compat else low)).alias("d"))


def ks_p_value(d: Column, n: Column, compat: bool = False) -> Column:
    """Probability of a distance this large: Kolmogorov's series (``compat``: without alternating signs)."""
    lam = F.sqrt(n) * d
    k = F.sequence(F.lit(1), F.lit(100))
    if compat:
        series = F.aggregate(k, F.lit(0.0), lambda a, i: a + 2 * F.exp(-2.0 * i * i * lam * lam))
        return F.when(lam < 0.01, 1.0).when(lam < 1.18, 1 - F.exp(-2 * lam * lam)).otherwise(F.least(F.lit(1.0), series))
    series = F.aggregate(k, F.lit(0.0), lambda a, i: a + F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * lam * lam))
    # below 0.2 the sum is 1 to twelve digits, but the series converges slowly
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def fit_normal(df: DataFrame, column: str, *by: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mu"), F.coalesce(F.stddev_pop(x), F.lit(1.0)).alias("sigma"))


def fit_lognormal(df: DataFrame, column: str, *by: str) -> DataFrame:
    x = F.col(column).cast("double")
    log = F.when(x > 0, F.log(F.when(x > 0, x)))
    return df.groupBy(*by).agg(F.avg(log).alias("mu"), F.least(F.lit(10.0), F.greatest(F.lit(0.01), F.stddev_pop(log))).alias("sigma"))


def fit_pareto(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Least positive value and the likeliest exponent; one pass, as the sum of ln(x / least) is a sum of logs."""
    x = F.when(F.col(column) > 0, F.col(column).cast("double"))
    log = F.log(x)
    excess = F.sum(log) - F.count(x) * F.log(F.min(x))
    alpha = F.least(F.lit(100.0), F.greatest(F.lit(0.1), F.coalesce(F.try_divide(F.count(x).cast("double"), excess), F.lit(100.0))))
    return df.groupBy(*by).agg(F.min(x).alias("least"), alpha.alias("alpha"))


def fit_student_t(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Degrees of freedom from the excess kurtosis, and the mean."""
    x = F.col(column).cast("double")
    kurt = F.when(F.min(x) < F.max(x), F.kurtosis(x)).otherwise(0.0)
    got = df.groupBy(*by).agg(kurt.alias("_k"), F.avg(x).alias("location"))
    df_ = F.when(F.col("_k") <= 0, 30.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(2.1), F.try_divide(F.lit(6.0), F.col("_k")) + 4)))
    return got.select(*by, df_.alias("df"), "location")


def fit_weibull(df: DataFrame, column: str, *by: str, compat: bool = False) -> DataFrame:
    """Shape and scale by regression of ln(-ln(1 - p)) on ln x over the ranks of positive values.

    The regression needs every rank, so rows are ordered within buckets of
    near values.
    """
    x = F.col(column).cast("double")
    rows = df.filter((x > 0) & (x < float("inf"))).select(*by, x.alias("_x"), value_bucket(x).alias("_bucket"))
    placed = with_offsets(rows, F.lit(1), *by)
    rank = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_x")) + F.col("_offset")
    p = (rank - 0.5) / F.col("n")
    points = placed.select(*by, F.log("_x").alias("_lx"), F.log(-F.log(1 - p)).alias("_ly"))
    spread = F.var_pop("_lx")
    slope = F.when(spread > 1e-10, F.try_divide(F.covar_pop("_lx", "_ly"), spread)).otherwise(1.0)
    got = points.groupBy(*by).agg(slope.alias("_s"), F.avg("_lx").alias("_mx"), F.avg("_ly").alias("_my"))
    shape = F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("_s")))
    intercept = F.col("_my") - F.col("_s") * F.col("_mx")
    scale = F.exp(intercept) if compat else F.exp(-intercept / F.col("_s"))
    return got.select(*by, shape.alias("shape"), scale.alias("scale"))


def test_fit(df: DataFrame, column: str, family: str, *by: str, compat: bool = False) -> DataFrame:
    """Fit a family, then its distance and p-value: parameters, n, d, p."""
    ranked = ranked_counts(df, column, *by)
    fits = {"normal": fit_normal, "lognormal": fit_lognormal, "pareto": fit_pareto, "student_t": fit_student_t}
    fitted = fit_weibull(df, column, *by, compat=compat) if family == "weibull" else fits[family](df, column, *by)
    names = [c for c in fitted.columns if c not in by]
    joined = ranked.join(fitted, list(by)) if by else ranked.crossJoin(F.broadcast(fitted))
    x = F.col("x")
    cdf = {
        "normal": lambda: normal_cdf(x, F.col("mu"), F.col("sigma")),
        "lognormal": lambda: F.when(x <= 0, 0.0).otherwise(normal_cdf(F.log(F.when(x > 0, x)), F.col("mu"), F.col("sigma"))),
        "pareto": lambda: F.when(x < F.col("least"), 0.0).otherwise(1 - F.pow(F.try_divide("least", x), F.col("alpha"))),
        "weibull": lambda: F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(F.greatest(x, F.lit(0.0)) / F.col("scale"), F.col("shape")))),
        "student_t": lambda: student_t_cdf(x - F.col("location"), F.col("df")),
    }[family]()
    tested = ks(joined.withColumn("_cdf", cdf), F.col("_cdf"), *by, *names, compat=compat)
    return tested.withColumn("p", ks_p_value(F.col("d"), F.col("n"), compat))


def lag_correlation(df: DataFrame, column: str, index: str, block: int, *by: str) -> DataFrame:
    """Lag-1 autocorrelation within blocks of consecutive indices; an incomplete last block is left out."""
    number = F.floor(F.col(index) / block)
    keyed = df.select(*by, number.alias("block"), F.col(index).alias("_i"), F.col(column).cast("double").alias("_x"))
    before = F.lag("_x").over(W.partitionBy(*by, "block").orderBy("_i"))
    pairs = keyed.withColumn("_y", before)
    x, y = F.when(F.col("_y").isNotNull(), F.col("_x")), F.col("_y")
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    got = pairs.groupBy(*by, "block").agg(F.count("*").alias("n"), F.when(scale >= 1e-10, F.try_divide(F.covar_pop(x, y), scale)).alias("corr"))
    return got.filter(F.col("n") == block)


def energy(spectrum: DataFrame, sigma: str, *by: str) -> DataFrame:
    """Cumulative share of squared singular values in falling order: rank, share.

    A group's order is cut into buckets of near values, as for ranks.
    """
    s2 = F.col(sigma) * F.col(sigma)
    rows = spectrum.select(*by, sigma).withColumn("_bucket", value_bucket(-F.col(sigma).cast("double")))
    first = with_offsets(rows, F.lit(1), *by).withColumnRenamed("_offset", "_rank").drop("n")
    placed = with_offsets(first, s2, *by)
    order = W.partitionBy(*by, "_bucket").orderBy(F.desc(sigma))
    sums = F.sum(s2).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")
    share = F.when(F.col("n") < 1e-300, 1.0).otherwise(F.try_divide(sums, F.col("n")))
    return placed.select(*by, sigma, (F.row_number().over(order) + F.col("_rank")).cast("int").alias("rank"), share.alias("share"))


def effective_rank(energies: DataFrame, threshold: float, *by: str, strict: bool = False) -> DataFrame:
    """First rank whose cumulative share reaches the threshold (``strict``: exceeds it)."""
    hit = F.col("share") > threshold if strict else F.col("share") >= threshold
    return energies.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.max("rank")).alias("effective_rank"))


def capped_hits(df: DataFrame, hit: Column, index: str, cap: int, *by: str) -> DataFrame:
    """The first ``cap`` rows that hit, in order of ``index``.

    Rows that miss are left out first, and each task keeps no more than
    ``cap`` rows a group before the shuffle.
    """
    keys = list(by) or [F.lit(1)]
    number = F.row_number().over(W.partitionBy(*keys).orderBy(index))
    return df.filter(hit).withColumn("_k", number).filter(F.col("_k") <= cap).drop("_k")


def chunk_ranges(spark, total: int, size: int) -> DataFrame:
    """chunk_id, start, end of consecutive chunks."""
    start = F.col("id") * size
    return spark.range(-(-total // size)).select(F.col("id").alias("chunk_id"), start.alias("start"), F.least(start + size, F.lit(total)).alias("end"))
