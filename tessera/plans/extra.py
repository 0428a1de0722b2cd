"""Further named queries over whole tables: files written and read back, conversions, budgets, injections and their checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions, dtypes, formats, names
from tessera.operators import catalog, generate, injection, linalg, numeric, stats, transcripts
from tessera.plans import models
from tessera.plans.queries import Query, rounded
from tessera.plans.tables import CATALOGUE, WHOLE_MATRIX, catalogue, matrix, read

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_OWN: list[str] = []


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tensor files: under ``spark.checkpoint.dir``, or on this machine where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tessera-files-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    return f"{root.rstrip('/').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


# ---- tensor files


@query(f"""
    WITH {CATALOGUE}, o AS (SELECT *, sum(bytes) OVER (ORDER BY name) AS upto FROM catalogue)
    SELECT name, dtype, shape[1] || ',' || shape[2] AS shape, CAST(upto - bytes AS BIGINT) AS "begin", CAST(upto AS BIGINT) AS "end" FROM o
""")
def a_headers(s, d):
    """The whole catalogue filled with seeded values, written as tensor files, and their headers read back."""
    path = scratch(s, "headers")
    models.generate_model(s, path, catalogue(s, d).select("name", names.layer_number(F.col("name")).alias("layer"), "shape", "dtype"), 42)
    return models.on_one_scale(models.catalogue(s, path, strict=True)).select("name", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), "begin", "end")


@query("""
    WITH o AS (SELECT p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS val FROM part)
    SELECT name, idx, round(val, 4) AS val FROM o
""")
def a_values(s, d):
    """Values written as one F32 tensor a brand, read back in chunks."""
    path = scratch(s, "values")
    rows = read(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))).alias("v"))
    vals = F.transform("v", lambda x: x["p_retailprice"].cast("double"))
    ready = rows.select("name", F.lit("F32").alias("dtype"), F.array(F.size("v").cast("bigint")).alias("shape"), numeric.encode_values(vals, F.lit("F32")).alias("payload"))
    models.safetensors.register(s)
    ready.repartition(4, "name").sortWithinPartitions("name").write.format("safetensors").mode("overwrite").save(path)
    return s.read.format("safetensors_values").option("chunk", 64).load(path).select("name", "idx", F.round("val", 4).alias("val"))


@query(f"""
    WITH {CATALOGUE} SELECT 'INFO' AS severity, count(*) AS n, sum(shape[1] * shape[2])::DOUBLE AS elements FROM catalogue
""")
def m_files(s, d):
    """Files of the whole catalogue checked by their headers alone; no issue but the notes."""
    path = scratch(s, "checked")
    models.generate_model(s, path, catalogue(s, d).select("name", names.layer_number(F.col("name")).alias("layer"), "shape", "dtype"), 7)
    bad = models.validate_files(s, path).select("severity", F.lit(0).cast("double").alias("elements"))
    notes = models.catalogue(s, path).select(F.lit("INFO").alias("severity"), dtypes.num_elements(F.col("shape")).cast("double").alias("elements"))
    return notes.unionByName(bad).groupBy("severity").agg(F.count("*").alias("n"), F.sum("elements").alias("elements"))


# ---- names, formats, budgets


@query(f"""
    WITH {CATALOGUE}, r AS (SELECT name, CASE WHEN contains(name, 'layernorm') THEN 'normalisation' WHEN contains(name, 'experts.') THEN 'expert routé'
        WHEN contains(name, 'q_proj') THEN 'attention Q' WHEN contains(name, 'k_proj') THEN 'attention K' WHEN contains(name, 'o_proj') THEN 'attention O'
        WHEN contains(name, 'mlp.gate') THEN 'routeur MoE' WHEN contains(name, 'up_proj') THEN 'MLP up' WHEN contains(name, 'down_proj') THEN 'MLP down' ELSE 'autre' END AS label FROM catalogue)
    SELECT label, count(*) AS n FROM r GROUP BY 1
""")
def c_labels(s, d):
    """C116, C117: tensors by their role's label."""
    return catalogue(s, d).select(names.role_label(names.tensor_role(F.col("name"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""
    SELECT n_nationkey AS code, coalesce(['Succès', 'Erreur générale', 'Argument invalide', 'Modèle invalide', 'Erreur d''entrée/sortie', 'Validation échouée', 'Comparaison incompatible'][n_nationkey + 1], 'Code inconnu') AS description FROM nation
""")
def c_exit_codes(s, d):
    """C230."""
    code = F.col("n_nationkey")
    return read(s, d, "nation").select(code.cast("bigint").alias("code"), formats.exit_description(code).alias("description"))


@query(f"""
    WITH {CATALOGUE}, x AS (SELECT name, bytes * 40000 AS size FROM catalogue)
    SELECT name, size, CAST(CASE WHEN size < 1048576 THEN size WHEN size <= 33554432 THEN 1048576 ELSE 8388608 END AS BIGINT) AS chunk FROM x
""")
def c_chunks(s, d):
    """How large a chunk tensors of a size are written in."""
    sized = catalogue(s, d).select("name", (F.col("bytes") * 40000).alias("size"))
    return sized.select("name", "size", formats.adaptive_chunk(F.col("size")).cast("bigint").alias("chunk"))


@query(f"""
    WITH {CATALOGUE}, b AS (SELECT path, count(*) AS tensors, sum(bytes) AS size, 16 + 88 * count(*) AS header FROM catalogue GROUP BY 1),
    t AS (SELECT *, size * 3 AS total FROM b)
    SELECT path, CAST(header AS BIGINT) AS header, CAST(greatest(0, total - header - 24576 - floor(total * 0.02)) AS BIGINT) AS left_over,
        abs(size + header - total) / total <= 0.7 AS kept, total - header - 24576 - floor(total * 0.02) >= size AS suffices, true AS constrained FROM t
""")
def k_budgets(s, d):
    """What a size budget leaves for values, and whether sizes keep to it."""
    b = catalogue(s, d).groupBy("path").agg(F.count("*").alias("tensors"), F.sum("bytes").alias("size"))
    header, total = generate.header_estimate(F.col("tensors")), F.col("size") * 3
    left = generate.budget_left(total, header, F.lit(generate.METADATA_BYTES))
    return b.select(
        "path", header.cast("bigint").alias("header"), left.cast("bigint").alias("left_over"), generate.budget_kept(F.col("size") + header, total, 0.7).alias("kept"),
        generate.budget_suffices(F.lit("full_structural"), left, F.col("size")).alias("suffices"), generate.budget_suffices(F.lit("size_constrained"), left, F.col("size")).alias("constrained"),
    )


# ---- covariance and structured generators


@query("""
    WITH n AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, ((a.n_nationkey * 7 + b.n_nationkey * 3) % 19 - 9) / 10.0 AS rho FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)
    SELECT i AS row, j AS col, CAST(rho AS DOUBLE) AS val FROM n UNION ALL SELECT j, i, CAST(rho AS DOUBLE) FROM n UNION ALL SELECT n_nationkey, n_nationkey, 1.0 FROM nation
""")
def j_pairwise(s, d):
    """A correlation matrix from the list of its upper triangle."""
    n = read(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"))
    size = n.count()
    j = F.explode(F.sequence(F.col("i") + 1, F.lit(size - 1)))
    upper = n.filter(F.col("i") < size - 1).select("i", j.alias("j"))
    k = F.floor(F.col("i") * (2 * size - F.col("i") - 1) / 2) + F.col("j") - F.col("i") - 1
    listed = upper.select(k.cast("bigint").alias("k"), (((F.col("i") * 7 + F.col("j") * 3) % 19 - 9) / 10.0).alias("rho"))
    return linalg.pairwise_cells(listed, size).select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val"))


@query("SELECT p_partkey AS row, p_partkey AS col, round(p_retailprice, 6) AS val, round(sqrt(p_retailprice), 6) AS root FROM part")
def j_diagonal(s, d):
    """Diagonal covariances with their factors."""
    return rounded(linalg.diagonal(read(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("variance"))), 6)


@query(f"""
    WITH {WHOLE_MATRIX} SELECT a.row, f.i AS col, round(0.5 * sum(a.val * f.w), 6) AS val
    FROM matrix a JOIN (SELECT i // 64 AS i, i % 64 AS c, ((i // 64 * 7 + i % 64 * 3) % 11 - 5) / 10.0 AS w FROM range(256) t(i)) f ON a.col = f.c WHERE a.row BETWEEN 0 AND 19 GROUP BY 1, 2
""")
def j_row_block(s, d):
    """One block of rows of a product (the block is the feature)."""
    i = F.col("id")
    row, col = F.floor(i / 64), i % 64
    factor = s.range(256).select(row.alias("row"), col.alias("col"), (((row * 7 + col * 3) % 11 - 5) / 10.0).alias("val"))
    return linalg.product(matrix(s, d).select("row", "col", "val"), F.broadcast(factor), 0.5, (0, 20)).withColumn("val", F.round("val", 6))


@query(f"WITH {WHOLE_MATRIX} SELECT label, count(DISTINCT col) AS n, round(sum(val * val), 4) AS energy FROM matrix GROUP BY 1")
def j_trace(s, d):
    """The squares of a label's singular values add up to those of its cells."""
    sigma = linalg.singular_values(matrix(s, d), "label")
    return sigma.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy"))


@query()
def k_xorshift(s, d):
    """Normals by a 64-bit xorshift register, one stream a part (no SQL form; tested against a plain loop)."""
    return generate.xorshift_normals(read(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") + 1).alias("seed")).repartition(8, "key"), 64)


@query()
def k_blocks(s, d):
    """One block of values a nation, the even ones correlated within (no SQL form)."""
    blocks = [(4, distributions.Normal(k, 1.0) if k % 2 else distributions.Laplace(0, 1.0), None if k % 2 else [0.3] * 6) for k in range(read(s, d, "nation").count())]
    return generate.block_values(s, blocks, 5)


@query()
def k_local(s, d):
    """A draw for each part, its columns equicorrelated within blocks (no SQL form)."""
    return generate.local_draws(s, [3, 5, 8], [0.5, 0.2, -0.1], read(s, d, "part").count(), 11)


@query()
def l_inject(s, d):
    """A matrix with a row a part, put through all stages (no SQL form)."""
    policy = injection.Policy(structure_probability=1.0, structure_size=8, correlation=0.4, low_rank_probability=1.0, outlier_frequency=0.02, heavy_tail_probability=0.3)
    return injection.inject(s, read(s, d, "part").count(), 16, distributions.Normal(0, 0.02), policy, 9)


# ---- amplitudes and checks


@query("""
    SELECT event_type, 2.5 AS fixed, round(1.5 * stddev_samp(value), 4) AS relative, round(abs(quantile_cont(value, 0.1)), 4) AS of_quantile FROM events GROUP BY 1
""")
def l_amplitudes(s, d):
    """Outlier amplitudes by three strategies."""
    e = read(s, d, "events")
    kinds = {"fixed": ("fixed", 2.5), "relative": ("std", 1.5), "of_quantile": ("quantile", 0.1)}
    parts = [injection.amplitude(e, "value", how, x, "event_type").withColumnRenamed("amplitude", name) for name, (how, x) in kinds.items()]
    return rounded(parts[0].join(parts[1], "event_type").join(parts[2], "event_type"))


_MEASURED = """m AS (SELECT event_type AS path, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT event_type AS path, avg(CASE WHEN abs(value - mean) / std > 2 THEN 1.0 ELSE 0.0 END) AS outlier_ratio FROM events JOIN m ON event_type = m.path GROUP BY 1)"""


def _measured(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("event_type").alias("path"), "value")
    moments = e.groupBy("path").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    far = F.abs(F.col("value") - F.col("mean")) / F.col("std") > 2
    return e.join(moments, "path").groupBy("path", "mean", "std", "n").agg(F.avg(far.cast("double")).alias("outlier_ratio"))


@query(f"""
    WITH {_MEASURED}, c AS (
        SELECT path, 'outlier_ratio' AS "check", abs(outlier_ratio - 0.04) AS deviation, 0.01 AS tolerance FROM o
        UNION ALL SELECT path, 'std_relative', abs(std / 45 - 1), 0.15 FROM m
        UNION ALL SELECT path, 'correlation', NULL, 0.1 FROM m)
    SELECT path, "check", round(deviation, 6) AS deviation, coalesce(deviation >= tolerance, true) AS failed FROM c
""")
def m_injection(s, d):
    """Measured tensors against an injection policy."""
    tensors = _measured(s, d).withColumn("correlation", F.lit(None).cast("double"))
    return rounded(injection.policy_deviations(tensors, F.lit(0.04), F.lit(45.0), F.lit(0.5)), 6)


@query(f"""
    WITH {_MEASURED} SELECT 'STATISTICAL' AS category, 'WARNING' AS severity, 'mean off' AS message, path FROM m WHERE abs(mean - 50) > 0.2
    UNION ALL SELECT 'STATISTICAL', 'WARNING', 'std off', path FROM m WHERE abs(std - 50) > 0.2
    UNION ALL SELECT 'OUTLIER', 'WARNING', 'many outliers', path FROM o WHERE outlier_ratio > 0.045
""")
def m_tensors(s, d):
    """Tensors by absolute differences."""
    return injection.tensor_issues(_measured(s, d).withColumn("expected_mean", F.lit(50.0)).withColumn("expected_std", F.lit(50.0)), 0.2, 0.045)


@query(f"""
    WITH {CATALOGUE}, r AS (SELECT path, count(*) AS n FROM catalogue GROUP BY 1)
    SELECT severity, message, count(*) AS n FROM (SELECT 'ERROR' AS severity, unnest(['number of tensors', 'seed is 0']) AS message FROM r) GROUP BY 1, 2
""")
def m_generation(s, d):
    """A report a shard that counts one tensor too many and has no seed, against the tensors of the shard."""
    c = catalogue(s, d).withColumn("elements", dtypes.num_elements(F.col("shape")).cast("bigint"))
    reports = c.groupBy("path").agg((F.count("*") + 1).alias("tensors"), F.sum("elements").alias("parameters"), F.lit(0).alias("seed"))
    return injection.generation_problems(reports, c, "path").groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("""
    SELECT conv_id, turn, '{"name":"' || role || '"}' AS tool, role AS name, sha256(coalesce(text, '')) AS arguments, true AS same FROM conversations
""")
def q_openai(s, d):
    """Q12-Q14: tools and calls from the common exchange format and back, a call for each turn."""
    c = read(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call = F.struct(F.lit("function").alias("type"), F.struct(F.col("role").alias("name"), F.col("text").alias("arguments")).alias("function"))
    tool = F.struct(F.lit("function").alias("type"), F.struct(F.col("role").alias("name")).alias("function"))
    given = c.withColumn("calls", F.to_json(F.array(call))).withColumn("tools", F.to_json(F.array(tool)))
    own = given.withColumn("own", transcripts.calls_from_openai(F.col("calls")))
    back = transcripts.calls_to_openai(F.col("own"))
    return own.select("conv_id", "turn", transcripts.tools_from_openai(F.col("tools"))[0].alias("tool"), F.col("own")[0]["name"].alias("name"), F.sha2(F.col("own")[0]["arguments"], 256).alias("arguments"), (back == F.col("calls")).alias("same"))
