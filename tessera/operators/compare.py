"""Comparison of two catalogues (inventory D1-D6, E1-E15, E19, F52-F56).

Both sides are joined by name with equi-joins that Spark plans by size; diffs
are rows (diff_type, path, original, compared), scores one-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The compared keys of a configuration.
CONFIG_KEYS = ["vocab_size", "hidden_size", "num_layers", "num_heads", "num_experts", "intermediate_size"]
# Weights of the global score.
SCORE_WEIGHTS = {"config": 0.20, "architecture": 0.25, "tensors": 0.20, "shapes": 0.15, "dtypes": 0.10, "sharding": 0.10}


def status(score: Column, n_diffs: Column, unknown: Column | None = None) -> Column:
    out = F.when(n_diffs == 0, "MATCH").when(score >= 0.8, "PARTIAL").otherwise("DIFFERENT")
    return out if unknown is None else F.when(unknown, "UNKNOWN").otherwise(out)


def _sides(original: DataFrame, compared: DataFrame, key: str, *values: str, how: str) -> DataFrame:
    """One row a name; repeated names count once, with the greatest values."""

    def side(df: DataFrame, mark: str) -> DataFrame:
        named = df.groupBy(key).agg(F.max(F.struct(*values)).alias(mark)) if values else df.select(key).distinct()
        return named.withColumn(f"has_{mark}", F.lit(True))

    return side(original, "a").join(side(compared, "b"), key, how)


def tensor_diffs(original: DataFrame, compared: DataFrame, key: str = "name") -> DataFrame:
    """Names that only one side has."""
    both = _sides(original, compared, key, how="full_outer")
    kind = F.when(F.col("has_b").isNull(), "REMOVED").when(F.col("has_a").isNull(), "ADDED")
    return both.select(kind.alias("diff_type"), F.col(key).alias("path")).filter("diff_type is not null")


def compare_tensors(original: DataFrame, compared: DataFrame, key: str = "name") -> DataFrame:
    """Counts of names, score = common / union, status and number of blocking removals."""
    both = _sides(original, compared, key, how="full_outer")
    a, b = F.col("has_a").isNotNull(), F.col("has_b").isNotNull()
    critical = F.col(key).contains("weight") | F.col(key).contains("bias")
    got = both.agg(
        F.count("*").alias("total"), F.count_if(a & b).alias("common"), F.count_if(a & ~b).alias("original_only"),
        F.count_if(b & ~a).alias("compared_only"), F.count_if(a & ~b & critical).alias("blocking"),
    )
    score = F.coalesce(F.try_divide(F.col("common").cast("double"), F.col("total")), F.lit(0.0))
    return got.withColumn("score", score).withColumn("status", status(score, F.col("total") - F.col("common"), F.col("total") == 0))


def compare_values(original: DataFrame, compared: DataFrame, value: str, key: str = "name") -> DataFrame:
    """Shapes or types of common names: total, matching, score (1 without common names), status; every mismatch blocks."""
    both = _sides(original, compared, key, value, how="inner")
    got = both.agg(F.count("*").alias("total"), F.count_if(F.col(f"a.{value}").eqNullSafe(F.col(f"b.{value}"))).alias("matching"))
    score = F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("total")), F.lit(1.0))
    return got.withColumn("score", score).withColumn("blocking", F.col("total") - F.col("matching")).withColumn("status", status(score, F.col("blocking")))


def value_diffs(original: DataFrame, compared: DataFrame, value: str, key: str = "name") -> DataFrame:
    both = _sides(original, compared, key, value, how="inner")
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    return both.filter(~a.eqNullSafe(b)).select(F.lit("MODIFIED").alias("diff_type"), F.col(key).alias("path"), a.cast("string").alias("original"), b.cast("string").alias("compared"))


def compare_sharding(original: DataFrame, compared: DataFrame, key: str = "name", shard: str = "shard", size: str = "byte_size") -> DataFrame:
    """Shard counts and, for common names, shard and size."""
    both = _sides(original, compared, key, shard, size, how="inner")
    same_shard = F.col(f"a.{shard}").eqNullSafe(F.col(f"b.{shard}"))
    same_size = F.col(f"a.{size}").eqNullSafe(F.col(f"b.{size}"))
    got = both.agg(
        F.count("*").alias("total"), F.count_if(same_shard & same_size).alias("matching"),
        F.count_if(~same_shard).alias("moved"), F.count_if(same_shard & ~same_size).alias("resized"),
    )
    shards = original.agg(F.countDistinct(shard).alias("shards_a")).crossJoin(compared.agg(F.countDistinct(shard).alias("shards_b")))
    joined = got.crossJoin(shards)  # one row each
    score = F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("total")), F.lit(1.0))
    other = (F.col("shards_a") != F.col("shards_b")).cast("int")
    return joined.withColumn("score", score).withColumn("blocking", F.col("moved") + other).withColumn("status", status(score, F.col("total") - F.col("matching") + other))


def config_diffs(original: DataFrame, compared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fixed keys against two (key, val) tables; a key that both lack matches (diff_type null)."""
    spark = original.sparkSession
    domain = spark.createDataFrame([(k,) for k in keys or CONFIG_KEYS], "key string")
    a = original.groupBy("key").agg(F.max("val").alias("original"))
    b = compared.groupBy("key").agg(F.max("val").alias("compared"))
    x, y = F.col("original"), F.col("compared")
    kind = F.when(x.eqNullSafe(y), None).when(y.isNull(), "REMOVED").when(x.isNull(), "ADDED").otherwise("MODIFIED")
    return domain.join(a, "key", "left").join(b, "key", "left").select(F.col("key").alias("path"), kind.alias("diff_type"), "original", "compared")


def compare_configs(original: DataFrame, compared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    diffs = config_diffs(original, compared, keys)
    kind = F.col("diff_type")
    blocks = (kind == "REMOVED") | ((kind == "MODIFIED") & F.col("path").isin("vocab_size", "hidden_size"))
    got = diffs.agg(F.count("*").alias("total"), F.count_if(kind.isNull()).alias("matching"), F.count_if(blocks).alias("blocking"))
    score = F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("total")), F.lit(1.0))
    return got.withColumn("score", score).withColumn("status", status(score, F.col("total") - F.col("matching")))


def compare_architectures(original: DataFrame, compared: DataFrame) -> DataFrame:
    """Six properties; expert counts never block."""
    diffs = config_diffs(original, compared)
    kind = F.col("diff_type")
    blocks = kind.isNotNull() & F.col("path").isin("num_layers", "hidden_size", "vocab_size")
    got = diffs.agg(F.count("*").alias("total"), F.count_if(kind.isNull()).alias("matching"), F.count_if(blocks).alias("blocking"))
    score = F.coalesce(F.try_divide(F.col("matching").cast("double"), F.col("total")), F.lit(1.0))
    label = F.when(F.col("total") == F.col("matching"), "IDENTICAL").when(score >= 0.8, "COMPATIBLE").when(score > 0, "DIFFERENT").otherwise("UNKNOWN")
    return got.withColumn("score", score).withColumn("architecture", label)


def global_score(scores: dict[str, Column], blocking: Column, compat: bool = False) -> list[Column]:
    """Weighted percentage and status (``compat``: in whole tenths)."""
    weighted = sum((scores[k] * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    percent = F.floor(10 * weighted + 1e-9) * 10.0 if compat else 100 * weighted
    label = F.when((percent >= 100) & (blocking == 0), "MATCH").when((percent < 50) | (blocking > 0), "DIFFERENT").otherwise("PARTIAL")
    return [percent.alias("percent"), label.alias("status"), (percent >= 80).alias("acceptable") if not compat else ((percent >= 80) & (blocking == 0)).alias("acceptable")]


def first_rule(rows: DataFrame, rules: DataFrame, value: str, *outputs: str, most_rules: int = 1000) -> DataFrame:
    """Range lookup (inventory E16): of the rules (ord, lo, hi, ...) whose span holds the value, the first counts.

    The rules are a configuration of at most ``most_rules`` rows (more raise).
    Their ends cut the line into disjoint pieces, each with its first rule;
    a value finds its piece by an expression, and pieces are an equi-join.
    """
    spans = rules.select("ord", "lo", "hi").filter("lo <= hi").limit(most_rules + 1).collect()
    if len(spans) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    ends = sorted({e for r in spans for e in (r["lo"], r["hi"])})
    pieces = []  # 2 i + 1 is the i-th end itself, 2 i what lies before it
    for i, end in enumerate(ends):
        for piece, holds in ((2 * i, lambda r: r["lo"] < end <= r["hi"]), (2 * i + 1, lambda r: r["lo"] <= end <= r["hi"])):
            hit = min((r["ord"] for r in spans if holds(r)), default=None)
            if hit is not None:
                pieces.append((piece, hit))
    spark = rows.sparkSession
    table = spark.createDataFrame(pieces, "_piece int, _ord long") if pieces else spark.createDataFrame([], "_piece int, _ord long")
    first = rules.groupBy(F.col("ord").cast("long").alias("_ord")).agg(F.min(F.struct(*outputs)).alias("_rule"))
    chosen = table.join(first, "_ord").drop("_ord")
    x, line = F.col(value), F.array(*[F.lit(e) for e in ends]) if ends else F.array().cast("array<double>")
    place = 2 * F.size(F.filter(line, lambda e: e < x)) + F.coalesce(F.array_contains(line, x), F.lit(False)).cast("int")
    joined = rows.withColumn("_piece", F.when(x.isNotNull(), place)).join(F.broadcast(chosen), "_piece", "left")
    return joined.select(*rows.columns, *[F.col(f"_rule.{c}").alias(c) for c in outputs])
