"""Whole programs over model folders: inspect, validate, compare, generate (inventory A5-A14, E19, M14, P2-P5, B21-B29)."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import dtypes, names
from tessera.operators import catalog, compare, numeric, stats
from tessera.operators import generate as values_of
from tessera.sources import safetensors

CONFIG = (
    "model_type string, architectures array<string>, hidden_size bigint, num_hidden_layers bigint, num_attention_heads bigint, num_key_value_heads bigint, "
    "intermediate_size bigint, vocab_size bigint, max_position_embeddings bigint, torch_dtype string, rms_norm_eps double, rope_theta double, "
    "qk_nope_head_dim bigint, v_head_dim bigint, kv_lora_rank bigint, "
    "moe struct<num_experts:bigint,top_k:bigint,n_shared_experts:bigint,router_dtype:string,routed_scaling_factor:double,norm_topk_prob:boolean,topk_method:string,first_k_dense_replace:bigint,layer_types:array<string>,expert_dtype:string,sparse_attention:boolean>"
)


def catalogue(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Tensors of a file or folder with their declared bytes."""
    safetensors.register(spark)
    rows = spark.read.format("safetensors").option("mode", "strict" if strict else "permissive").load(path)
    return rows.withColumn("bytes", F.col("end") - F.col("begin"))


def on_one_scale(c: DataFrame) -> DataFrame:
    """The catalogue of a folder with offsets that run on from shard to shard."""
    files = c.select("path", (F.col("file_size") - F.col("header_size")).alias("_payload")).distinct()
    upto = F.sum("_payload").over(W.orderBy(F.length("path"), "path"))  # one row a file; numbers of six digits come last
    before = files.select("path", (upto - F.col("_payload")).alias("_before"))
    return c.join(F.broadcast(before), "path").withColumns({k: F.col(k) + F.col("_before") for k in ("begin", "end")}).drop("_before")


def config(spark: SparkSession, folder: str) -> DataFrame:
    """A model's configuration as a typed row with defaults and its kind of attention."""
    c = spark.read.schema(CONFIG).json(os.path.join(folder, "config.json"), multiLine=True)
    heads, kv = F.coalesce("num_attention_heads", F.lit(0)), F.coalesce("num_key_value_heads", "num_attention_heads", F.lit(0))
    named = F.coalesce("architectures", F.array().cast("array<string>"))
    attention = (
        F.when(F.exists(named, lambda a: a.contains("Dsa")), "Dsa")
        .when(F.exists(named, lambda a: a.contains("Deepseek")), "Mla")
        .when(F.col("qk_nope_head_dim").isNotNull() | F.col("v_head_dim").isNotNull() | F.col("kv_lora_rank").isNotNull(), "Mla")
        .when(F.col("moe.sparse_attention"), "Dsa")
        .when(heads == kv, "Dense")
        .otherwise("Gqa")
    )
    whole = [F.coalesce(c_, F.lit(0)).alias(c_) for c_ in ("hidden_size", "num_hidden_layers", "intermediate_size", "vocab_size", "max_position_embeddings")]
    return c.select(
        F.coalesce("model_type", F.lit("unknown")).alias("model_type"), named.alias("architectures"), names.architecture_type(named).alias("architecture"),
        *whole, heads.alias("num_attention_heads"), kv.alias("num_key_value_heads"), attention.alias("attention"),
        F.coalesce(dtypes.parse_dtype(F.col("torch_dtype")), F.lit("F32")).alias("dtype"),
        F.coalesce("rms_norm_eps", F.lit(1e-5)).alias("rms_norm_eps"), F.coalesce("rope_theta", F.lit(1e4)).alias("rope_theta"),
        F.when(heads > 0, F.floor(F.col("hidden_size") / heads)).alias("head_dim"), "moe",
    )


def config_issues(c: DataFrame) -> DataFrame:
    """Broken invariants of configurations (rows of ``config``): model_type, problem."""
    heads, kv, hidden = F.col("num_attention_heads"), F.col("num_key_value_heads"), F.col("hidden_size")
    rules = [
        (hidden < 1, "hidden_size is not positive"),
        (F.col("num_hidden_layers") < 1, "no layers"),
        (F.col("vocab_size") < 1, "no vocabulary"),
        (heads < 1, "no attention heads"),
        (F.col("attention").isin("Dense", "Gqa") & (heads > 0) & (F.try_mod(hidden, heads) != 0), "heads do not divide hidden_size"),
        (F.col("attention").isin("Dense", "Gqa") & (kv > 0) & (F.try_mod(heads, kv) != 0), "key heads do not divide heads"),
        (F.col("moe.top_k") > F.col("moe.num_experts") + F.coalesce("moe.n_shared_experts", F.lit(0)), "top_k exceeds the experts"),
        (F.col("moe.routed_scaling_factor") <= 0, "the scaling factor is not positive"),
        (F.col("moe.first_k_dense_replace") > F.size("moe.layer_types"), "more dense layers than layers"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), m) for r, m in rules]), lambda x: x.isNotNull())
    return c.select("model_type", F.explode(found).alias("problem"))


def inspect(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a model's structure, sizes, roll-ups, shards and, for folders, its configuration."""
    c = catalogue(spark, path)
    tables = {"structure": catalog.structure(c), "physical": catalog.physical(c), "rollups": catalog.rollups(c), "shards": catalog.shard_table(c), "dimensions": catalog.dimensions(c)}
    if os.path.exists(os.path.join(path, "config.json")):
        tables["config"] = config(spark, path)
    return tables


def validate_files(spark: SparkSession, path: str) -> DataFrame:
    """Header rules as issues: order and bounds of offsets, sizes, unique names."""
    c = catalogue(spark, path)
    payload = F.col("file_size") - F.col("header_size")
    expected = dtypes.byte_size(F.col("shape"), F.col("dtype"))
    rules = [
        (F.col("begin") > F.col("end"), "ERROR", "begin after end"),
        (F.col("end") > payload, "CRITICAL", "end after payload"),
        (F.coalesce(F.col("bytes") != expected, F.lit(False)), "ERROR", "size does not fit shape and type"),
        (dtypes.has_zero_dim(F.col("shape")), "CRITICAL", "zero dimension"),
        (~dtypes.is_supported_for_write(F.col("dtype")), "WARNING", "type below one byte"),
    ]
    found = F.filter(F.array(*[F.when(r, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for r, s, m in rules]), lambda x: x.isNotNull())
    rows = c.select(F.lit("STRUCTURAL").alias("category"), F.col("name").alias("path"), F.explode(found).alias("i")).select("category", "i.severity", "i.message", "path")
    twice = catalog.duplicates(c).select(F.lit("STRUCTURAL").alias("category"), F.lit("ERROR").alias("severity"), F.lit("repeated name").alias("message"), F.col("name").alias("path"))
    return rows.unionByName(twice)


def compare_models(spark: SparkSession, original: str, compared: str, compat: bool = False) -> DataFrame:
    """One row: scores of names, shapes, types and shards, the weighted percentage, status."""
    a, b = catalogue(spark, original), catalogue(spark, compared)
    parts = {
        "tensors": compare.compare_tensors(a, b),
        "shapes": compare.compare_values(a, b, "shape"),
        "dtypes": compare.compare_values(a, b, "dtype"),
        "sharding": compare.compare_sharding(*[x.withColumn("shard", F.dense_rank().over(W.orderBy("path"))) for x in (a, b)], size="bytes"),  # metadata of one model
    }
    sizes = [x.agg(F.countDistinct("path").alias(f"files_{k}"), F.count("*").alias(f"count_{k}")) for k, x in (("a", a), ("b", b))]
    row = sizes[0].crossJoin(sizes[1])
    for k, part in parts.items():
        row = row.crossJoin(part.select(F.col("score").alias(k), F.col("blocking").alias(f"{k}_blocking")))
    # without configurations, equal file and tensor counts stand for them
    row = row.withColumn("config", F.when(F.col("files_a") == F.col("files_b"), 1.0).otherwise(0.5)).withColumn("architecture", F.when(F.col("count_a") == F.col("count_b"), 1.0).otherwise(0.5))
    blocking = sum((F.col(f"{k}_blocking") for k in parts), F.lit(0))
    keys = ["config", "architecture", *parts]
    return row.select(*keys, blocking.alias("blocking"), *compare.global_score({k: F.col(k) for k in keys}, blocking, compat))


def tensor_payloads(spark: SparkSession, plan: DataFrame, seed: int, version: str = "v1", model: str = "model", chunk: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """name, dtype, shape, chunk_id, payload and the columns ``keep`` of a catalogue filled with seeded normals of deviation 0.02; one row a chunk.

    Chunks carry what their tensor's rows need, so values are encoded in the
    task that makes them and never shuffled as doubles.
    """
    carried = ("dtype", "shape", *keep)
    sized = plan.withColumn("elements", dtypes.num_elements(F.col("shape")).cast("bigint"))
    chunks = values_of.chunk_table(sized.select("name", "layer", "elements", *carried), chunk, model, version, seed, carried)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as in stream_values: chunks grow into values
    arrays = values_of.stream_arrays(chunks.repartition(tasks, "name", "chunk_id"), "normal", 0.0, 0.02, carried)
    return arrays.select("name", "dtype", "shape", "chunk_id", numeric.encode_values(F.col("vals"), F.col("dtype")).alias("payload"), *keep)


def generate_model(spark: SparkSession, path: str, plan: DataFrame, seed: int, shard_bytes: int = 1 << 30, header_bytes: int = safetensors.MOST_HEADER) -> None:
    """Write a catalogue's tensors as shards of bounded size, with headers that readers take, and an index."""
    safetensors.register(spark)
    sized = plan.withColumn("bytes", dtypes.byte_size(F.col("shape"), F.col("dtype")).cast("bigint"))
    sized = sized.withColumn("header", safetensors.entry_bytes(F.col("name"), F.col("dtype"), F.col("shape"), F.greatest("bytes", F.lit(shard_bytes))))
    placed = catalog.shard_plan(sized, shard_bytes, most_header=header_bytes - 8).select("name", F.col("shard").alias("_shard"))
    shards = placed.agg(F.max("_shard")).first()[0]
    rows = tensor_payloads(spark, plan.join(placed, "name"), seed, keep=("_shard",)).repartitionById(int(shards), (F.col("_shard") - 1).cast("int"))
    ordered = rows.sortWithinPartitions("name", "chunk_id").select("name", "dtype", "shape", "payload")
    ordered.write.format("safetensors").mode("overwrite").save(path)


# Files that a model must have beside its tensors, and those that it may have.
REQUIRED_FILES = ["config.json", "generation_config.json", "tokenizer.json", "tokenizer_config.json"]
OPTIONAL_FILES = ["special_tokens_map.json", "chat_template.jinja"]
# Where the parts of a generated model come from, and how sure they are.
PROVENANCE = {
    "model": ("Generated", "Synthetic"), "seed": ("Observed", "Exact"), "distribution": ("Derived", "Estimated"), "structure": ("Derived", "Estimated"),
    "outlier": ("Derived", "Estimated"), "dtype": ("Observed", "Exact"), "size": ("Observed", "Exact"),
}


def copy_config_files(source: str, path: str, required: list[str] = REQUIRED_FILES, optional: list[str] = OPTIONAL_FILES) -> list[str]:
    """Copy a model's configuration files; a required one that is missing raises."""
    copied = []
    for name in [*required, *optional]:
        if os.path.exists(os.path.join(source, name)):
            shutil.copyfile(os.path.join(source, name), os.path.join(path, name))
            copied.append(name)
        elif name in required:
            raise FileNotFoundError(os.path.join(source, name))
    return copied


def tensor_statistics(spark: SparkSession, path: str, threshold: float = 3.0) -> DataFrame:
    """name, role, mean, std, quantiles and outlier_rate of every tensor of a model, from its values."""
    safetensors.register(spark)
    values = spark.read.format("safetensors_values").load(path).select("name", "val")
    moments = values.groupBy("name").agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"))
    far = values.join(moments, "name").groupBy("name").agg(F.avg((F.abs(F.col("val") - F.col("mean")) > threshold * F.col("std")).cast("double")).alias("outlier_rate"))
    quantiles = stats.quantiles(values, "val", [0.05, 0.5, 0.95], "name")
    return moments.join(far, "name").join(quantiles, "name").select("name", names.tensor_role(F.col("name")).alias("role"), "mean", "std", F.struct("p5", "p50", "p95").alias("quantiles"), "outlier_rate")


def write_reports(spark: SparkSession, path: str) -> None:
    """Statistics and provenance of a model as JSON files in its folder ``reports``; one row a tensor comes to the driver."""
    folder = os.path.join(path, "reports")
    os.makedirs(folder, exist_ok=True)
    tensors = [json.loads(r[0]) for r in tensor_statistics(spark, path).orderBy("name").select(F.to_json(F.struct("*"))).collect()]
    provenance = {k: {"origin": origin, "confidence": confidence} for k, (origin, confidence) in PROVENANCE.items()}
    for name, value in (("statistics.json", {"tensors": tensors}), ("provenance.json", provenance)):
        write_json(os.path.join(folder, name), value)


def write_json(path: str, value: dict) -> None:
    """Written aside and renamed."""
    aside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}")
    with open(aside, "w") as f:
        json.dump(value, f, indent=2)
    os.replace(aside, path)


def generate(spark: SparkSession, path: str, layers: int, hidden: int, heads: int, intermediate: int, vocab: int, seed: int) -> None:
    """A small dense model: shards, index, configuration, manifest and statistics."""
    os.makedirs(path, exist_ok=True)
    plan = catalog.blueprint(spark, layers, hidden, heads, heads, intermediate, vocab)
    generate_model(spark, path, plan, seed)
    cfg = {"model_type": "synthetic", "architectures": ["LlamaForCausalLM"], "hidden_size": hidden, "num_hidden_layers": layers, "num_attention_heads": heads, "num_key_value_heads": heads, "intermediate_size": intermediate, "vocab_size": vocab, "torch_dtype": "bfloat16"}
    tensors = [{"name": r["name"], "shape": r["shape"], "dtype": r["dtype"]} for r in plan.select("name", "shape", "dtype").orderBy("name").collect()]  # metadata of one model
    manifest = {"model_type": "synthetic", "seed": seed, "tensors": tensors, "total_tensors": len(tensors)}
    for name, value in (("config.json", cfg), ("manifest.json", manifest)):
        write_json(os.path.join(path, name), value)
    write_reports(spark, path)
