"""Rule checks as issue rows and scores (inventory D7-D12, F45-F53, M1-M25).

An issue has category, severity, message and path; deviations beyond the
tolerance are WARNING, beyond twice the tolerance ERROR.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.formats import outlier_magnitude, relative_error

# Severities in order, weights of the issue scores.
SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
SCORE_WEIGHTS = {"structural": 0.30, "distribution": 0.25, "correlation": 0.20, "low_rank": 0.15, "outlier": 0.10}


def severity_rank(severity: Column) -> Column:
    """0 to 3."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def band(deviation: Column, tolerance: Column | float) -> Column:
    return F.when(deviation > 2 * F.lit(tolerance), "ERROR").when(deviation > F.lit(tolerance), "WARNING")


def issues(rows: DataFrame, path: str, *rules: tuple[str, Column, Column]) -> DataFrame:
    """One row for each rule (category, severity or null, message) that fires."""
    found = F.array(*[F.struct(F.lit(c).alias("category"), s.alias("severity"), m.alias("message")) for c, s, m in rules])
    live = F.filter(found, lambda x: x["severity"].isNotNull())
    return rows.select(F.col(path).alias("path"), F.explode(live).alias("i")).select("i.category", "i.severity", "i.message", "path")


def statistics(stats: DataFrame, path: str, tolerance: float) -> DataFrame:
    """Issues of mean and std against target_mean and target_std."""
    mean, std = relative_error(F.col("mean"), F.col("target_mean")), relative_error(F.col("std"), F.col("target_std"))
    return issues(
        stats, path,
        ("STATISTICAL", band(mean, tolerance), F.concat(F.lit("mean off by "), F.format_number(mean, 6))),
        ("STATISTICAL", band(std, tolerance), F.concat(F.lit("std off by "), F.format_number(std, 6))),
    )


def distribution(tests: DataFrame, path: str, significance: float) -> DataFrame:
    """Issues of fits whose p-value is below the significance (below a tenth of it: ERROR)."""
    severity = F.when(F.col("n") == 0, "ERROR").when(F.col("p") < significance / 10, "ERROR").when(F.col("p") < significance, "WARNING")
    return issues(tests, path, ("DISTRIBUTION", severity, F.concat(F.lit("p = "), F.format_number("p", 6))))


def outliers(values: DataFrame, column: str, threshold: float, max_frequency: float, path: str) -> DataFrame:
    """Frequency and magnitude of outliers of each group, with the resulting issue."""
    x = F.col(column).cast("double")
    moments = values.groupBy(path).agg(F.avg(x).alias("_mu"), F.stddev_pop(x).alias("_sd"))
    z = outlier_magnitude(x, F.col("_mu"), F.col("_sd"))
    far = z > threshold
    got = values.join(moments, path).groupBy(path).agg(F.count(x).alias("n"), F.count_if(far).alias("n_outliers"), F.coalesce(F.max(F.when(far, z)), F.lit(0.0)).alias("max_magnitude"))
    frequency = F.coalesce(F.try_divide(F.col("n_outliers").cast("double"), F.col("n")), F.lit(0.0))
    by_share = F.when(frequency > 2 * max_frequency, "ERROR").when(frequency > max_frequency, "WARNING")
    by_size = F.when(F.col("max_magnitude") > 2 * threshold, "WARNING")
    told = F.when((F.col("n_outliers") > 0) & by_share.isNull() & by_size.isNull(), "INFO")
    return got.withColumn("frequency", frequency).withColumn("frequency_issue", by_share).withColumn("magnitude_issue", by_size).withColumn("note", told)


def shape_severity(observed: Column, expected: Column) -> Column:
    """The worst finding on a shape: rank or zero dimension CRITICAL, other difference ERROR."""
    return (
        F.when((F.size(observed) != F.size(expected)) | F.exists(observed, lambda d: d == 0), "CRITICAL").when(observed != expected, "ERROR")
    )


def dtype_severity(observed: Column, expected: Column) -> Column:
    return F.when(~observed.eqNullSafe(expected), "ERROR")


def dtype_pair_severity(a_kind: Column, b_kind: Column, operation: str) -> Column:
    """Mixed kinds warn in arithmetic; what is no number cannot be multiplied as a matrix."""
    numeric = a_kind.isin("float", "signed", "unsigned") & b_kind.isin("float", "signed", "unsigned")
    if operation in ("matmul", "dot"):
        return F.when(~numeric, "ERROR")
    mixed = (a_kind == "float") != (b_kind == "float")
    return F.when(mixed, "WARNING") if operation in ("add", "mul", "sub", "div") else F.lit(None).cast("string")


def low_rank_severity(rank: Column, dimension: Column, share: Column, threshold: float) -> Column:
    return F.when(share < threshold, "WARNING").when(rank < 0.5 * dimension, "INFO")


def correlation_severity(observed: Column, expected: Column, tolerance: float) -> Column:
    return F.when(observed.isNull(), "ERROR").otherwise(band(F.abs(observed - expected), tolerance))


def tally(found: DataFrame, *by: str) -> DataFrame:
    """Issue counts by severity, validity, and the five scores with their weighted sum."""
    rank = severity_rank(F.col("severity"))
    n = F.count("severity")

    def number(r: int) -> Column:
        return F.count_if(rank == r)

    def share(category: str) -> Column:
        return F.coalesce(F.try_divide(F.count_if(F.col("category") == category).cast("double"), n), F.lit(0.0))

    got = found.groupBy(*by).agg(
        n.alias("n_issues"), number(0).alias("n_info"), number(1).alias("n_warning"), number(2).alias("n_error"), number(3).alias("n_critical"),
        share("DISTRIBUTION").alias("_d"), share("CORRELATION").alias("_c"), share("LOW_RANK").alias("_r"), share("OUTLIER").alias("_o"),
    )
    structural = 1 - F.least(F.lit(1.0), 0.01 * F.col("n_info") + 0.05 * F.col("n_warning") + 0.2 * F.col("n_error") + 0.5 * F.col("n_critical"))
    scores = {"structural": structural, "distribution": 1 - F.col("_d"), "correlation": 1 - F.col("_c"), "low_rank": 1 - F.col("_r"), "outlier": F.greatest(F.lit(0.0), 1 - 10 * F.col("_o"))}
    total = reduce(lambda a, b: a + b, [scores[k] * w for k, w in SCORE_WEIGHTS.items()])
    return got.select(
        *by, "n_issues", "n_info", "n_warning", "n_error", "n_critical", ((F.col("n_error") + F.col("n_critical")) == 0).alias("valid"),
        *[v.alias(k) for k, v in scores.items()], total.alias("score"), (F.col("n_critical") > 0).alias("masked"),
    )


def report(found: DataFrame, *by: str) -> DataFrame:
    """Issues of each group as one JSON document, in order of path and message."""
    listed = F.array_sort(F.collect_list(F.struct("path", "category", "severity", "message")))
    return found.groupBy(*by).agg(F.to_json(F.struct(F.count("*").alias("total"), listed.alias("issues"))).alias("report"))
