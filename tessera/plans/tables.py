"""The driver's tables seen as tensors, catalogues and configurations, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes

PARTS = ["self_attn.q_proj", "self_attn.k_proj", "self_attn.o_proj", "mlp.gate_proj", "mlp.up_proj", "mlp.down_proj", "input_layernorm", "mlp.experts.3.up_proj"]
TYPES = ["F32", "F16", "BF16", "I8"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tensors: path, name, dtype, shape, bytes."""
    k = F.col("p_partkey")
    name = F.concat(
        F.lit("model.layers."), (k % 12).cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, PARTS)), (k % 8 + 1).cast("int")), F.lit("."), k.cast("string"), F.lit(".weight")
    )
    dtype = F.element_at(F.array(*map(F.lit, TYPES)), (k % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"), name.alias("name"), dtype.alias("dtype"), F.array(F.col("p_size").cast("bigint"), k % 7 + 1).alias("shape")
    )
    return rows.withColumn("bytes", dtypes.byte_size(F.col("shape"), F.col("dtype")).cast("bigint"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PARTS) + "]"
_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
CATALOGUE = f"""catalogue AS (
    SELECT p_brand AS path,
        'model.layers.' || (p_partkey % 12) || '.' || {_LIST}[p_partkey % 8 + 1] || '.' || p_partkey || '.weight' AS name,
        {_TYPES}[p_partkey % 4 + 1] AS dtype,
        [CAST(p_size AS BIGINT), p_partkey % 7 + 1] AS shape,
        CAST(p_size AS BIGINT) * (p_partkey % 7 + 1) * [4, 2, 2, 1][p_partkey % 4 + 1] AS bytes,
        p_partkey
    FROM part
)"""


def two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the catalogue: some tensors gone, some reshaped, retyped or moved."""
    base = catalogue(spark, sf_dir).withColumn("k", F.regexp_extract("name", r"\.([0-9]+)\.weight$", 1).cast("bigint"))
    a = base.filter(F.col("k") % 10 != 0).drop("k")
    k = F.col("k")
    b = base.filter(k % 7 != 0).select(
        F.when(k % 13 == 0, "Brand#99").otherwise(F.col("path")).alias("path"), "name",
        F.when(k % 9 == 0, "F64").otherwise(F.col("dtype")).alias("dtype"),
        F.when(k % 11 == 0, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("shape")).alias("shape"),
        F.when(k % 17 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
    )
    return a, b


TWO_MODELS = f"""{CATALOGUE},
a AS (SELECT * FROM catalogue WHERE p_partkey % 10 <> 0),
b AS (
    SELECT CASE WHEN p_partkey % 13 = 0 THEN 'Brand#99' ELSE path END AS path, name,
        CASE WHEN p_partkey % 9 = 0 THEN 'F64' ELSE dtype END AS dtype,
        CASE WHEN p_partkey % 11 = 0 THEN [1] ELSE shape END AS shape,
        CASE WHEN p_partkey % 17 = 0 THEN bytes + 1 ELSE bytes END AS bytes
    FROM catalogue WHERE p_partkey % 7 <> 0
)"""


def two_configs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = [("vocab_size", "32000"), ("hidden_size", "4096"), ("num_layers", "32"), ("num_heads", "32"), ("other", "1")]
    b = [("vocab_size", "32000"), ("hidden_size", "2048"), ("num_layers", "32"), ("intermediate_size", "11008")]
    return tuple(spark.createDataFrame(x, "key string, val string") for x in (a, b))


TWO_CONFIGS = """ca(key, val) AS (VALUES ('vocab_size', '32000'), ('hidden_size', '4096'), ('num_layers', '32'), ('num_heads', '32'), ('other', '1')),
cb(key, val) AS (VALUES ('vocab_size', '32000'), ('hidden_size', '2048'), ('num_layers', '32'), ('intermediate_size', '11008')),
keys(path) AS (VALUES ('vocab_size'), ('hidden_size'), ('num_layers'), ('num_heads'), ('num_experts'), ('intermediate_size')),
diffs AS (
    SELECT path, CASE WHEN ca.val IS NOT DISTINCT FROM cb.val THEN NULL WHEN cb.val IS NULL THEN 'REMOVED' WHEN ca.val IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS diff_type,
        ca.val AS original, cb.val AS compared
    FROM keys LEFT JOIN ca ON path = ca.key LEFT JOIN cb ON path = cb.key
)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a long matrix: label, row, col, val."""
    return read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val")).withColumn("val", F.col("val").cast("double"))


WHOLE_MATRIX = "matrix AS (SELECT label, vec_id AS row, unnest(range(len(embedding))) AS col, unnest(CAST(embedding AS DOUBLE[])) AS val FROM embeddings)"
