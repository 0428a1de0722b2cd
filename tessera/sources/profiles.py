"""JSON documents as typed rows: profiles, manifests, generation metadata (inventory A15, A16, A25-A27, B23-B30, C138, C210, F41, F61)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes, formats

STATISTICAL = (
    "name string, version string, description string, "
    "distributions struct<weight_distribution:string,outlier_distribution:string,correlation_strength:double,low_rank_strength:double>, "
    "outlier_config struct<probability:double,severity_factor:double,layer_variation:boolean>, "
    "correlation_config struct<enabled:boolean,max_correlation:double,layer_decay:double>, "
    "low_rank_config struct<enabled:boolean,rank_ratio:double,strength:double>, "
    "super_weight_config struct<enabled:boolean,probability:double,magnitude_factor:double>"
)
MODEL = (
    "model_type string, architecture string, hidden_size bigint, num_attention_heads bigint, num_hidden_layers bigint, vocab_size bigint, max_position_embeddings bigint, "
    "n_routed_experts bigint, n_shared_experts bigint, expert_capacity bigint, tensor_patterns array<string>, head_dim bigint, kv_lora_rank bigint"
)
MANIFEST = (
    "model_type string, model_name string, architecture string, generator_version string, seed bigint, "
    "tensors array<struct<name:string,shape:array<bigint>,dtype:string>>, total_parameters bigint, total_tensors bigint"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a document; malformed documents raise."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def statistical_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, STATISTICAL)


def model_profiles(spark: SparkSession, path: str, model_type: str | None = None) -> DataFrame:
    rows = read_json(spark, path, MODEL)
    return rows.filter(F.col("model_type") == model_type) if model_type else rows


def _broken(rows: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), m) for r, m in rules]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("problem"))


def _share(name: str) -> tuple[Column, str]:
    return ~F.col(name).between(0, 1), f"{name} is not in [0, 1]"


def statistical_problems(profiles: DataFrame) -> DataFrame:
    """Broken rules: name, problem."""
    shares = ["distributions.correlation_strength", "distributions.low_rank_strength", "outlier_config.probability", "correlation_config.max_correlation", "low_rank_config.rank_ratio", "super_weight_config.probability"]
    rules = [(F.coalesce("name", F.lit("")) == "", "no name"), *map(_share, shares), (F.col("outlier_config.severity_factor") <= 0, "severity is not positive"), (F.col("super_weight_config.magnitude_factor") <= 0, "magnitude is not positive")]
    return _broken(profiles, "name", rules)


def model_problems(profiles: DataFrame) -> DataFrame:
    """Broken rules: model_type, problem."""
    heads, hidden = F.col("num_attention_heads"), F.col("hidden_size")
    rules = [
        (F.coalesce(hidden, F.lit(0)) < 1, "hidden_size is not positive"),
        (F.coalesce(heads, F.lit(0)) < 1, "no attention heads"),
        (F.coalesce("num_hidden_layers", F.lit(0)) < 1, "no layers"),
        (F.coalesce("vocab_size", F.lit(0)) < 1, "no vocabulary"),
        ((heads > 0) & (F.try_mod(hidden, heads) != 0) & F.col("head_dim").isNull() & F.col("kv_lora_rank").isNull(), "heads do not divide hidden_size"),
        (F.col("expert_capacity") > F.col("n_routed_experts"), "capacity exceeds the experts"),
        (F.size("tensor_patterns") == 0, "no tensor patterns"),
    ]
    return _broken(profiles, "model_type", rules)


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """Tensors of manifests with elements and bytes (types of unknown size count one byte)."""
    rows = manifests.select("model_name", F.explode("tensors").alias("t")).select("model_name", "t.*")
    elements = dtypes.num_elements(F.col("shape"))
    return rows.withColumn("elements", elements).withColumn("bytes", elements * F.coalesce(dtypes.size_bytes(F.col("dtype")), F.lit(1)))


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Declared totals that differ from recomputed ones."""
    totals = manifest_rows(manifests).groupBy("model_name").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum("elements").alias("e"))
    joined = manifests.join(totals, "model_name", "left")
    rules = [
        (F.coalesce("n", F.lit(0)) == 0, "no tensors"),
        (F.col("n") != F.col("total_tensors"), "total_tensors differs"),
        (F.col("e") != F.col("total_parameters"), "total_parameters differs"),
        (F.col("names") != F.col("n"), "repeated names"),
    ]
    return _broken(joined, "model_name", rules)


def manifest_json(catalogue: DataFrame, model_name: str, seed: int, version: str) -> DataFrame:
    """One row: a catalogue (name, shape, dtype) as a manifest document, tensors in order of name."""
    got = catalogue.agg(
        F.array_sort(F.collect_list(F.struct("name", "shape", "dtype"))).alias("tensors"),
        F.sum(dtypes.num_elements(F.col("shape"))).cast("bigint").alias("total_parameters"),
        F.count("*").alias("total_tensors"),
    )
    fields = [F.lit(model_name).alias("model_name"), F.lit(version).alias("generator_version"), F.lit(seed).alias("seed"), "tensors", "total_parameters", "total_tensors"]
    return got.select(F.to_json(F.struct(*fields), {"pretty": "true"}).alias("json"))


def metadata_problems(metadata: DataFrame) -> DataFrame:
    """Rules on generation metadata rows (generation_id, timestamp_utc, config_hash, target, estimated and actual size, seed)."""
    rules = [
        (F.coalesce("generation_id", F.lit("")) == "", "no generation id"),
        (~formats.is_timestamp(F.col("timestamp_utc")), "malformed timestamp"),
        (~formats.is_hash(F.col("config_hash")), "malformed hash"),
        (F.col("estimated_size") < F.col("target_size"), "estimated size is below the target"),
        (F.col("actual_size") < F.col("estimated_size"), "actual size is below the estimate"),
    ]
    return _broken(metadata, "generation_id", rules)


def origin_problems(fields: DataFrame) -> DataFrame:
    """Provenance of fields (name, origin, confidence): what is unknown cannot be exact."""
    return _broken(fields, "name", [((F.col("origin") == "Unknown") & (F.col("confidence") == "Exact"), "unknown but exact")])


def chunk_problems(chunks: DataFrame, total: int) -> DataFrame:
    """Chunks (chunk_id, start, end) that do not join up: dense numbers, no gap, the whole covered."""
    from pyspark.sql import Window as W

    order = W.orderBy("chunk_id")  # chunk metadata of one tensor
    own = chunks.withColumn("_before", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("_i", F.row_number().over(order) - 1).withColumn("_last", F.lead("end").over(order).isNull())
    rules = [(F.col("chunk_id") != F.col("_i"), "numbers are not dense"), (F.col("start") != F.col("_before"), "gap or overlap"), (F.col("_last") & (F.col("end") != total), "the end is not covered")]
    return _broken(own, "chunk_id", rules)
