"""Composite injection of outliers and structure into tensors, and its check (inventory L11-L13, L20, M12, M15, M16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import Distribution, Normal
from tessera.functions.special import chi2_quantile
from tessera.operators import generate, stats
from tessera.operators.validate import issues

#: The stages, each with randomness of its own.
STAGES = ("distribution", "structure", "correlation", "low_rank", "super_weights", "heavy_tail")


@dataclass(frozen=True)
class Policy:
    structure_probability: float = 0.0
    structure: str = "diagonal_band"
    structure_size: int = 1
    correlation: float = 0.0
    low_rank_probability: float = 0.0
    low_rank: int = 1
    low_rank_alpha: float = 0.1
    outlier_frequency: float = 0.0
    outlier_scale: float = 10.0
    heavy_tail_probability: float = 0.0
    heavy_tail_df: float = 3.0


def stage_seed(seed: int, stage: str) -> int:
    """The seed of a stage: distinct for each stage and spread over 62 bits."""
    x = (seed * 0x9E3779B97F4A7C15 + (STAGES.index(stage) + 1) * 0xBF58476D1CE4E5B9) % (1 << 64)
    return ((x ^ (x >> 31)) * 0x94D049BB133111EB) % (1 << 62)


def student_draw(seed: int, df: float, *key: str | Column) -> Column:
    """A Student-t draw: a normal over the root of a chi-squared one by its degrees."""
    z = Normal().quantile(generate.counter_uniform(seed, *key))
    return z / F.sqrt(chi2_quantile(generate.counter_uniform(seed + 1, *key), F.lit(float(df))) / df)


def stage_draw(spark, seed: int, stage: str) -> float:
    """One uniform number that decides whether a stage takes place."""
    return spark.range(1).select(generate.counter_uniform(stage_seed(seed, stage), F.lit(-1)).alias("u")).first()["u"]


def inject(spark, rows: int, cols: int, distribution: Distribution, policy: Policy, seed: int) -> DataFrame:
    """row, col, idx, val: a matrix drawn from a distribution, then all stages."""
    drawn = generate.counter_values(generate.grid(spark, rows, cols), distribution, stage_seed(seed, "distribution"), "idx")
    return apply_to(drawn, rows, cols, policy, seed)


def apply_to(df: DataFrame, rows: int, cols: int, policy: Policy, seed: int) -> DataFrame:
    """The stages on a tensor (row, col, idx, val): structure, correlation and low rank on matrices, then super weights."""
    spark = df.sparkSession
    if rows > 1 and cols > 1:
        if stage_draw(spark, seed, "structure") < policy.structure_probability:
            df = generate.apply_mask(df, generate.sparse_mask(policy.structure, rows, cols, policy.structure_size))
        if policy.correlation:
            moments = df.agg(F.avg("val").alias("_mean"), F.stddev_pop("val").alias("_std"))
            std = F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std"))
            shared = generate.correlated_columns(spark, rows, cols, policy.correlation, 1.0, stage_seed(seed, "correlation")).select("idx", F.col("val").alias("_c"))
            joined = df.join(shared, "idx").crossJoin(F.broadcast(moments))  # one row
            df = joined.select("row", "col", "idx", (F.col("_mean") + std * F.col("_c")).alias("val"))
        if stage_draw(spark, seed, "low_rank") < policy.low_rank_probability:
            added = generate.low_rank(spark, rows, cols, min(policy.low_rank, rows, cols), stage_seed(seed, "low_rank"), policy.low_rank_alpha)
            df = df.join(added.withColumnRenamed("val", "_l"), ["row", "col"]).select("row", "col", "idx", (F.col("val") + F.col("_l")).alias("val"))
    return super_weights(df, policy, seed)


def super_weights(df: DataFrame, policy: Policy, seed: int) -> DataFrame:
    """Values that are hit become a Student-t draw or are scaled, each by chance."""
    own, tail = stage_seed(seed, "super_weights"), stage_seed(seed, "heavy_tail")
    heavy = student_draw(tail + 1, policy.heavy_tail_df, "idx")
    hit = F.when(generate.bernoulli(tail, policy.heavy_tail_probability, "idx"), heavy).otherwise(F.col("val") * policy.outlier_scale)
    return df.withColumn("val", F.when(generate.bernoulli(own, policy.outlier_frequency, "idx"), hit).otherwise(F.col("val")))


def amplitude(df: DataFrame, column: str, strategy: str, amount: float, *by: str, seed: int = 0) -> DataFrame:
    """by, amplitude: ``fixed`` amount, ``std`` (amount times the sample deviation), ``quantile`` (magnitude of one) or ``heavy_tail`` (magnitude of a t draw with amount degrees)."""
    groups = df.groupBy(*by)
    x = F.col(column).cast("double")
    if strategy == "fixed":
        return groups.agg(F.lit(float(amount)).alias("amplitude"))
    if strategy == "std":
        return groups.agg((amount * F.stddev_samp(x)).alias("amplitude"))
    if strategy == "quantile":
        got = stats.quantiles(df, column, [amount], *by)
        return got.select(*by, F.abs(F.col(got.columns[-1])).alias("amplitude"))
    if strategy == "heavy_tail":
        draw = student_draw(seed, amount, *(by or [F.lit(0)]))
        return groups.agg(F.count("*").alias("_n")).withColumn("amplitude", F.abs(draw)).drop("_n")
    raise ValueError(f"unknown strategy {strategy}")


def policy_deviations(measured: DataFrame, outlier_frequency: Column, target_std: Column, correlation: Column, tolerances: tuple[float, float, float] = (0.01, 0.15, 0.1)) -> DataFrame:
    """Rows (path, check, deviation, failed) of measured tensors (path, outlier_ratio, std, correlation) against a policy.

    What the policy does not ask for is not checked; a correlation that is
    asked for and was not measured fails.
    """
    def row(check: str, wanted: Column, deviation: Column, tolerance: float) -> Column:
        return F.when(wanted, F.struct(F.lit(check).alias("check"), deviation.alias("deviation"), F.coalesce(deviation >= tolerance, F.lit(True)).alias("failed")))

    expected = correlation * correlation
    checks = F.array(
        row("outlier_ratio", outlier_frequency > 0, F.abs(F.col("outlier_ratio") - outlier_frequency), tolerances[0]),
        row("std_relative", target_std > 0, F.abs(F.col("std") / target_std - 1), tolerances[1]),
        row("correlation", correlation > 0, F.abs(F.col("correlation") - expected), tolerances[2]),
    )
    return measured.select("path", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select("path", "c.*")


def tensor_issues(measured: DataFrame, tolerance: float, outlier_share: float = 3.0) -> DataFrame:
    """Issues of tensors (path, n, mean, std, outlier_ratio, expected_mean, expected_std) by absolute differences."""
    def off(observed: str, expected: str) -> Column:
        return F.when(F.abs(F.col(observed) - F.col(expected)) > tolerance, "WARNING")

    return issues(
        measured, "path",
        ("STRUCTURAL", F.when(F.col("n") == 0, "ERROR"), F.lit("no values")),
        ("STATISTICAL", off("mean", "expected_mean"), F.lit("mean off")),
        ("STATISTICAL", off("std", "expected_std"), F.lit("std off")),
        ("OUTLIER", F.when(F.col("outlier_ratio") > outlier_share, "WARNING"), F.lit("many outliers")),
    )


def generation_problems(reports: DataFrame, specs: DataFrame, *by: str) -> DataFrame:
    """Rows (by, severity, message) where a generation report (tensors, parameters, seed) does not fit its specs (name, elements)."""
    made = specs.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("elements").alias("_p"), F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("_nameless"))
    both = reports.join(made, list(by), "left") if by else reports.crossJoin(F.broadcast(made))  # one row each
    rules = [
        (F.col("tensors") != F.coalesce("_n", F.lit(0)), "number of tensors"),
        (F.col("parameters") != F.coalesce("_p", F.lit(0)), "number of parameters"),
        (F.col("_nameless") > 0, "tensor without a name"),
        (F.col("seed") == 0, "seed is 0"),
    ]
    found = F.array(*[F.when(r, F.struct(F.lit("ERROR").alias("severity"), F.lit(m).alias("message"))) for r, m in rules])
    return both.select(*by, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(*by, "i.severity", "i.message")
