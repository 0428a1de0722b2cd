"""Further queries: same rows as their SQL; generators, conversions, checks and exact quantiles against plain code."""

import json
import math
import os
import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import distributions
from tessera.operators import catalog, compare, generate, injection, linalg, ordered, stats, transcripts
from tessera.plans import extra, models
from tessera.sources import safetensors
from test_queries import DATA, db, plain  # noqa: F401

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(extra.QUERIES))
def test_same_rows_as_sql(spark, db, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, DATA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    if name not in extra.SQL:
        assert df.count() > 0
        return
    columns = sorted(df.columns)
    relation = db.sql(extra.SQL[name])
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 5), float(rng.randrange(5)), 0.0, -1e9])) for _ in range(2000)] + [("c", 7.0), ("d", None), ("a", float("nan")), ("e", float("inf")), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    p = [0.0, 0.1, 0.5, 0.99, 1.0]
    for r in stats.quantiles(df, "x", p, "g").collect():
        own = [x for g, x in rows if g == r["g"] and x is not None and not math.isnan(x)]
        expected = [None] * 5 if not own else [float(np.quantile(own, q)) for q in p] if r["g"] != "e" else [1.0, 1.2, 2.0, float("inf"), float("inf")]
        assert [a if a is None else pytest.approx(a, rel=1e-9) for a in expected] == [r["p0"], r["p10"], r["p50"], r["p99"], r["p100"]]
    whole = stats.quantiles(df.filter("g = 'a'"), "x", [0.25]).first()[0]
    assert whole == pytest.approx(float(np.quantile([x for g, x in rows if g == "a" and not math.isnan(x)], 0.25)))
    assert stats.quantiles(df.limit(0), "x", [0.5]).first()[0] is None
    far = stats.outliers_by_quantile(df.filter("g is null"), "x", 0.9, "g").count()
    own = [abs(x) for g, x in rows if g is None]
    assert far == sum(x > np.quantile(own, 0.9) for x in own)


def test_energy_over_buckets(spark):
    rng = random.Random(5)
    rows = [(g, abs(rng.gauss(0, 3))) for g in ("a", None) for _ in range(300)]
    got = sorted(((r["g"] or "", r["rank"], r["share"]) for r in ordered.energy(spark.createDataFrame(rows, "g string, s double"), "s", "g").collect()))
    expected = []
    for g in ("", "a"):
        own = sorted((s for k, s in rows if (k or "") == g), reverse=True)
        total = sum(s * s for s in own)
        expected += [(g, i + 1, sum(s * s for s in own[: i + 1]) / total) for i in range(len(own))]
    assert [x[:2] for x in got] == [x[:2] for x in expected] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, expected))


def test_first_rule_matches_a_plain_search(spark):
    rng = random.Random(6)
    rules = [(k, lo, lo + rng.randrange(8), f"r{k}") for k, lo in enumerate(rng.sample(range(60), 20))] + [(99, 5, 3, "empty")]
    values = [(i, rng.choice([None, *range(-3, 75)])) for i in range(300)]
    df, table = spark.createDataFrame(values, "id long, v int"), spark.createDataFrame(rules, "ord int, lo int, hi int, out string")
    got = compare.first_rule(df, table, "v", "out")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    expected = {i: None if v is None else next((o for _, lo, hi, o in sorted(rules) if lo <= v <= hi), None) for i, v in values}
    assert {r["id"]: r["out"] for r in got.collect()} == expected
    assert compare.first_rule(df, table.limit(0), "v", "out").filter("out is not null").count() == 0
    with pytest.raises(ValueError):
        compare.first_rule(df, table, "v", "out", most_rules=5)


def test_amplitudes_go_round_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), F.lit(1.0).alias("val"))
    specs = spark.createDataFrame([(k, "add" if k % 2 else "multiply", float(k)) for k in range(100)], "ord long, kind string, amount double")
    got = {r["idx"]: r["val"] for r in generate.round_robin_amplitudes(df, F.col("idx") % 7 == 3, specs, block=50).collect()}
    hits = [i for i in range(1000) if i % 7 == 3]
    assert got == {i: 1.0 if i not in hits or hits.index(i) >= 100 else (1.0 + hits.index(i)) for i in range(1000)}


def test_xorshift_matches_a_plain_loop(spark):
    got = {(r["key"], r["idx"]): r["val"] for r in generate.xorshift_normals(spark.createDataFrame([(1, 42), (2, -5)], "key long, seed long"), 20).collect()}
    mask = (1 << 64) - 1
    for key, s in ((1, 42), (2, -5 & mask)):
        for i in range(20):
            for shift in (13, -7, 17):
                s ^= (s << shift) & mask if shift > 0 else s >> -shift
            t = (s + i * 6364136223846793005) & mask
            u, v = (s & 0xFFFFFFFF) / 0xFFFFFFFF, (t & 0xFFFFFFFF) / 0xFFFFFFFF
            assert got[key, i] == pytest.approx(math.sqrt(-2 * math.log(max(u, 1e-10))) * math.cos(2 * math.pi * v), abs=1e-9)


def test_blocks_and_local_correlations(spark):
    m = generate.local_draws(spark, [2, 3], [0.8, -0.3], 4000, 3)
    r = {(x["i"], x["j"]): x["corr"] for x in linalg.correlation_matrix(m).collect()}
    assert abs(r[0, 1] - 0.8) < 0.05 and abs(r[2, 4] + 0.3) < 0.05 and abs(r[0, 3]) < 0.05
    got = [x["val"] for x in generate.block_values(spark, [(3, distributions.Normal(100, 0.1), None), (2, distributions.Normal(0, 1), [0.5])], 1).orderBy("idx").collect()]
    z = [x["val"] for x in generate.counter_values(spark.range(3, 5).select(F.col("id").alias("idx")), distributions.Normal(0, 1), 1, "idx").orderBy("idx").collect()]
    assert all(abs(v - 100) < 1 for v in got[:3]) and got[3:] == [pytest.approx(z[0]), pytest.approx(0.5 * z[0] + 0.75**0.5 * z[1])]
    with pytest.raises(ValueError):
        generate.block_values(spark, [(0, distributions.Normal(), None)], 1)


def test_covariances(spark):
    rhos = [0.1, 0.2, 0.3, -0.1, 0.05, 0.4]
    cells = {(r["row"], r["col"]): r["val"] for r in linalg.pairwise(spark, 4, rhos).collect()}
    expected = np.eye(4)
    expected[np.triu_indices(4, 1)] = rhos
    expected = np.maximum(expected, expected.T) + np.minimum(np.tril(expected.T, -1) + np.triu(expected, 1), 0)
    assert len(cells) == 16 and all(cells[i, j] == cells[j, i] for i, j in cells)
    assert [cells[i, j] for i in range(4) for j in range(i + 1, 4)] == rhos
    factor = {(r["row"], r["col"]): r["val"] for r in linalg.covariance(linalg.pairwise(spark, 4, rhos)).collect()}
    low = np.linalg.cholesky(np.array([[cells[i, j] for j in range(4)] for i in range(4)]))
    assert all(factor[i, j] == pytest.approx(low[i, j]) for i in range(4) for j in range(i + 1))
    with pytest.raises(ValueError):
        linalg.pairwise(spark, 4, rhos[:5])
    with pytest.raises(ValueError):
        linalg.covariance(spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5)], "row long, col long, val double"))
    with pytest.raises(Exception):
        linalg.diagonal(spark.createDataFrame([(0, -1.0)], "i long, variance double")).collect()


def test_injection_stages(spark):
    base = distributions.Normal(0, 1)
    plain_draw = injection.inject(spark, 40, 30, base, injection.Policy(), 5).orderBy("idx").collect()
    again = injection.inject(spark, 40, 30, base, injection.Policy(), 5).orderBy("idx").collect()
    assert plain_draw == again and len(plain_draw) == 1200
    masked = injection.inject(spark, 40, 30, base, injection.Policy(structure_probability=1.0, structure_size=2), 5).filter("val <> 0")
    assert masked.filter("abs(row - col) > 2").isEmpty()
    scaled = {r["idx"]: r["val"] for r in injection.inject(spark, 40, 30, base, injection.Policy(outlier_frequency=0.1, outlier_scale=50.0), 5).collect()}
    changed = [r["idx"] for r in plain_draw if scaled[r["idx"]] != r["val"]]
    assert 70 < len(changed) < 170 and all(scaled[r["idx"]] == pytest.approx(50 * r["val"]) for r in plain_draw if r["idx"] in changed)
    tied = injection.inject(spark, 2000, 3, base, injection.Policy(correlation=0.8), 5)
    assert abs(linalg.correlation_matrix(tied).filter("i < j").agg(F.avg("corr")).first()[0] - 0.64) < 0.06
    low = injection.inject(spark, 20, 10, base, injection.Policy(low_rank_probability=1.0, low_rank=1, low_rank_alpha=5.0), 5).collect()
    gap = np.zeros((20, 10))
    for r in low:
        gap[r["row"], r["col"]] = r["val"] - plain_draw_value(spark, base, r["idx"])
    assert np.linalg.matrix_rank(gap, tol=1e-6) == 1
    draws = [r["x"] for r in spark.range(20000).select(injection.student_draw(3, 5.0, "id").alias("x")).collect()]
    assert abs(statistics.fmean(draws)) < 0.05 and abs(statistics.pvariance(draws) - 5 / 3) < 0.25


def plain_draw_value(spark, base, idx, seen={}):  # noqa: B006
    if not seen:
        seen.update({r["idx"]: r["val"] for r in injection.inject(spark, 20, 10, base, injection.Policy(), 5).collect()})
    return seen[idx]


def test_exchange_format(spark):
    tools = [{"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "number"}}}}}]
    calls = [{"type": "function", "function": {"name": "f", "arguments": '{"x": 1, "é": "\\n"}'}}, {"type": "function", "function": {"name": "g", "arguments": "{}"}}]
    row = spark.createDataFrame([(json.dumps(tools), json.dumps(calls)), (None, None)], "t string, c string").select(
        transcripts.tools_from_openai(F.col("t")).alias("t"), transcripts.calls_from_openai(F.col("c")).alias("c"), transcripts.calls_to_openai(transcripts.calls_from_openai(F.col("c"))).alias("back")
    )
    one, none = row.collect()
    assert [json.loads(x) for x in one["t"]] == [tools[0]["function"]]
    assert [tuple(x) for x in one["c"]] == [("f", calls[0]["function"]["arguments"]), ("g", "{}")] and json.loads(one["back"]) == calls
    assert none["t"] is None and none["c"] is None and none["back"] is None


def test_generation_report(spark):
    specs = spark.createDataFrame([("a", 10), ("", 5)], "name string, elements long")
    report = spark.createDataFrame([(2, 15, 0)], "tensors long, parameters long, seed long")
    assert {r["message"] for r in injection.generation_problems(report, specs).collect()} == {"tensor without a name", "seed is 0"}
    assert injection.generation_problems(spark.createDataFrame([(1, 10, 3)], "tensors long, parameters long, seed long"), specs.limit(1)).count() == 0


def test_reports_beside_a_generated_model(spark, tmp_path):
    path, source = str(tmp_path / "model"), tmp_path / "source"
    models.generate(spark, path, 1, 16, 2, 32, 50, 3)
    tensors = json.loads((tmp_path / "model" / "reports" / "statistics.json").read_text())["tensors"]
    assert {t["name"] for t in tensors} == {r["name"] for r in models.catalogue(spark, path).collect()}
    assert all(abs(t["mean"]) < 0.02 and 0.005 < t["std"] < 0.04 and t["quantiles"]["p5"] <= t["quantiles"]["p95"] for t in tensors)
    assert json.loads((tmp_path / "model" / "reports" / "provenance.json").read_text())["seed"] == {"origin": "Observed", "confidence": "Exact"}
    source.mkdir()
    for name in models.REQUIRED_FILES[:3]:
        (source / name).write_text("{}")
    with pytest.raises(FileNotFoundError):
        models.copy_config_files(str(source), path)
    (source / models.REQUIRED_FILES[3]).write_text("{}")
    assert models.copy_config_files(str(source), path) == models.REQUIRED_FILES


def test_values_of_a_file_are_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "model")
    models.generate_model(spark, path, spark.createDataFrame([("a", 0, [70, 3], "F32"), ("b", 1, [9], "BF16"), ("c", 1, [0], "F32")], "name string, layer long, shape array<bigint>, dtype string"), 3)
    one = spark.read.format("safetensors_values").load(path)
    many = spark.read.format("safetensors_values").option("slice", 100).option("chunk", 16).load(path)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 219
    assert many.filter("name = 'b'").count() == 9


def test_headers_beyond_one_file_are_split(spark, tmp_path):
    path = str(tmp_path / "model")
    name = F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.repeat(F.lit("é"), 15_000))  # 90,000 bytes of a header
    plan = spark.range(100).select(name.alias("name"), F.lit(0).alias("layer"), F.array(F.col("id") % 5 + 1).alias("shape"), F.lit("F16").alias("dtype"))
    models.generate_model(spark, path, plan, 3)
    assert sorted(x for x in os.listdir(path) if x.endswith(".safetensors")) == [f"model-{k:05d}-of-00002.safetensors" for k in (1, 2)] and not [x for x in os.listdir(path) if x[0] == "."]
    got = sorted((r["name"][:3], r["begin"], r["end"]) for r in models.on_one_scale(models.catalogue(spark, path, strict=True)).collect())
    ends = np.cumsum([2 * (k % 5 + 1) for k in range(100)]).tolist()
    assert got == [(f"{k:03}", ([0] + ends)[k], ends[k]) for k in range(100)]
    index = json.loads((tmp_path / "model" / "model.safetensors.index.json").read_text())
    assert index["metadata"]["total_size"] == ends[-1] and sorted(index["weight_map"]) == list(index["weight_map"]) and len(index["weight_map"]) == 100
    assert {n: os.path.basename(p) for n, p in models.catalogue(spark, path).select("name", "path").collect()} == index["weight_map"]


def test_headers_too_large_are_not_written(spark, tmp_path):
    with pytest.raises(safetensors.FormatError):
        safetensors.header_bytes([("x" * safetensors.MOST_HEADER, "F32", [1], 4)])
    safetensors.register(spark)
    for rows, parts in ([("x" * safetensors.MOST_HEADER, "I8", [1], bytearray(1))], 1), ([("same", "I8", [1], bytearray(1))] * 2, 2):
        with pytest.raises(Exception):
            spark.createDataFrame(rows, "name string, dtype string, shape array<long>, payload binary").repartition(parts).write.format("safetensors").mode("overwrite").save(str(tmp_path / f"m{parts}"))
        assert not [x for x in os.listdir(tmp_path / f"m{parts}") if x.endswith((".safetensors", ".json"))]


def test_entry_bytes_are_enough(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice('ab."\\/\n\x7fé€😀 ~') for _ in range(rng.randrange(30))) + str(k), rng.choice(["F32", "I8"]), [rng.randrange(300) for _ in range(rng.randrange(4))]) for k in range(200)]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<long>")
    for r in df.withColumn("n", safetensors.entry_bytes(F.col("name"), F.col("dtype"), F.col("shape"), F.lit(10**9))).collect():
        entry = json.dumps({r["name"]: {"dtype": r["dtype"], "shape": r["shape"], "data_offsets": [10**9, 10**9]}}, separators=(",", ":"))
        assert len(entry) - 1 <= r["n"] and (r["n"] == len(entry) - 1 or set(r["name"]) & set('"\\\n'))


def test_shard_plan_under_two_limits_matches_a_plain_fold(spark):
    rng = random.Random(8)
    for most, most_header in ((50, 10_000), (10_000, 50), (60, 40), (7, 9), (100_000, 100_000)):
        rows = [(f"t{k:03}", rng.choice([0, 0, 1, 3, 10, 49, 50, 51, 120]), rng.choice([1, 2, 5, 20, 60])) for k in rng.sample(range(1000), 400)] + [(None, 5, 5), ("u", None, None)]
        expected, shard, used = [], 1, [0, 0]
        for name, *sizes in sorted((n or "", b or 0, h or 0) for n, b, h in rows):
            if any(u and u + x > m for u, x, m in zip(used, sizes, (most, most_header))):
                shard, used = shard + 1, [0, 0]
            used = [u + x for u, x in zip(used, sizes)]
            expected.append((name, shard))
        df = spark.createDataFrame(rows, "name string, bytes long, header long")
        for range_rows in (1000, 40, 7):
            assert sorted((r["name"] or "", r["shard"]) for r in catalog.shard_plan(df, most, range_rows, most_header).collect()) == expected


def test_files_with_many_tensors_are_checked(spark, tmp_path):
    part = spark.range(75_000).select((F.col("id") + 10**17).alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))  # one header of all would have over 8 MiB
    expected = duckdb.sql(extra.SQL["m_files"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in extra.m_files(spark, str(tmp_path)).select("severity", "n", "elements").collect()] == expected == [("INFO", 75_000, float(sum(k % 7 + 1 for k in range(10**17, 10**17 + 75_000))))]


def test_values_are_encoded_where_they_are_made(spark):
    plan = spark.createDataFrame([("a", 0, [70, 3], "F32", 2), ("b", 1, [9], "BF16", 1)], "name string, layer long, shape array<bigint>, dtype string, _shard int")
    text = models.tensor_payloads(spark, plan, 3)._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above  # a shuffle of doubles takes two to eight times the bytes of the payload
    kept = models.tensor_payloads(spark, plan, 3, chunk=100, keep=("_shard",)).orderBy("name", "chunk_id").collect()
    assert [(r["name"], r["dtype"], r["shape"], r["chunk_id"], len(r["payload"]), r["_shard"]) for r in kept] == [
        ("a", "F32", [70, 3], 0, 400, 2), ("a", "F32", [70, 3], 1, 400, 2), ("a", "F32", [70, 3], 2, 40, 2), ("b", "BF16", [9], 0, 18, 1),
    ]
