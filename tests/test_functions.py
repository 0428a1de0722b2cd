import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, dtypes, formats, names, special
from tessera.operators import generate, linalg, numeric, ordered, transcripts, validate


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_special_functions_at_known_values():
    assert np.allclose(special.np_ln_gamma(np.array([0.5, 1, 5, 10.5, 100])), [math.lgamma(x) for x in (0.5, 1, 5, 10.5, 100)], atol=1e-12)
    assert np.allclose(special.np_ln_gamma(np.array([0.1, 0.3])), [math.lgamma(0.1), math.lgamma(0.3)], atol=1e-11)
    assert np.allclose(special.np_gamma_p(np.array([1.0, 1.0, 3.0]), np.array([1.0, 10.0, 2.0])), [1 - math.exp(-1), 1 - math.exp(-10), 0.3233235838169366], atol=1e-10)
    assert np.allclose(special.np_beta_inc(np.array([2.0, 0.5]), np.array([3.0, 0.5]), np.array([0.4, 0.5])), [0.5248, 0.5], atol=1e-9)
    assert np.allclose(special.np_student_t_cdf(np.array([0.0, 2.0, -2.0]), np.array([5.0, 5.0, 5.0])), [0.5, 0.9490302605850709, 0.0509697394149291], atol=1e-9)
    assert np.allclose(special.np_chi2_quantile(np.array([0.95, 0.5]), np.array([3.0, 2.0])), [7.814727903251179, 2 * math.log(2)], atol=1e-6)


def test_normal_functions(spark):
    r = one(spark, special.normal_inv_cdf(F.lit(0.975)), special.normal_inv_cdf(F.lit(0.001)), special.normal_cdf(F.lit(1.0)), special.normal_cdf_fine(F.lit(-1.96)), special.erf(F.lit(-0.5)))
    assert np.allclose(list(r), [1.959963985, -3.090232306, 0.841344746, 0.024997895, -0.520499878], atol=2e-7)


def test_distributions_integrate_and_invert(spark):
    for d in (distributions.Normal(1, 2), distributions.Laplace(1, 2), distributions.LogNormal(0, 0.5), distributions.Weibull(2, 1.5), distributions.Pareto(1, 3), distributions.Uniform(-1, 4)):
        back = spark.range(1, 10).select(d.cdf(d.quantile(F.col("id") / 10)).alias("u"), (F.col("id") / 10).alias("v")).collect()
        assert all(abs(r["u"] - r["v"]) < 1e-6 for r in back), d
    m = distributions.Mixture(((0.5, distributions.Normal(-1, 1)), (0.5, distributions.Normal(1, 1))))
    assert m.mean == 0 and m.variance == 2
    with pytest.raises(ValueError):
        distributions.Mixture(((0.5, distributions.Normal()),))
    assert distributions.from_family("lognormal", 2.0, 1.0).mean == pytest.approx(2.0)
    assert distributions.Pareto(1, 1).mean is None


def test_formats(spark):
    r = one(spark, formats.format_size(F.lit(1_500_000_000)), formats.format_bytes(F.lit(512)), formats.format_number(F.lit(1234567)), formats.format_duration(F.lit(3725)), formats.parse_size(F.lit("0k")), formats.pad_header(F.lit("{}")))
    assert list(r) == ["1.50 GB", "512 o", "1_234_567", "1h 2m 5s", None, "{}      "]
    bad = "sha256:" + "g" * 64
    r = one(spark, formats.is_hash(F.lit(bad)), formats.is_timestamp(F.lit("2026-01-01T00:00:00Z")), formats.divided(F.lit(12), F.lit(5)), formats.relative_error(F.lit(1.0), F.lit(0.0)))
    assert r[0] is False and r[1] is True and r[2] is None and r[3] == pytest.approx(1e10)


def test_seeds_match_hashlib(spark):
    def framed(s):
        return struct.pack("<Q", len(s.encode())) + s.encode()

    raw = struct.pack("<Q", 42) + framed("modèle") + framed("t.0") + struct.pack("<I", 0xFFFFFFFF) + framed("v1")
    seed = hashlib.sha256(raw).hexdigest()
    sub = hashlib.sha256(bytes.fromhex(seed) + framed("chunk") + struct.pack("<I", 7)).hexdigest()
    got = formats.derive_seed(F.lit(42), F.lit("modèle"), F.lit("t.0"), F.lit(None).cast("int"), F.lit("v1"))
    r = one(spark, got, formats.derive_secondary_seed(got, F.lit("chunk"), F.lit(7)), formats.seed_number(got))
    assert list(r)[:2] == [seed, sub] and int(r[2]) == int.from_bytes(bytes.fromhex(seed)[:8], "little")


def test_names(spark):
    rows = [("model.layers.3.mlp.experts.7.w1.weight", "MoeRoutedExpert", 3, 7), ("mtp.0.norm.weight", "Mtp", None, None), ("model.layers.x.layer.5.wq_a", "AttentionQuery", 5, None), ("HEAD.weight", "LmHead", None, None), ("a.w3.weight", "MlpGate", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "name string")
    n = F.col("name")
    got = df.select("name", names.tensor_role(n), names.layer_number(n), names.expert_number(n)).collect()
    assert [tuple(g) for g in got] == rows
    r = one(spark, names.matches(F.lit("a.1.2.b"), "a.{x}.b"), names.matches(F.lit("a.b"), "a.{x}.b"), names.matches(F.lit("xxa.bxx"), "a.b"), names.architecture_type(F.array(F.lit("Nope"), F.lit("LlamaModel"))))
    assert list(r) == [True, False, True, "Transformer + LLaMA"]


def test_dtypes(spark):
    r = one(spark, dtypes.parse_dtype(F.lit("torch.bfloat16")), dtypes.size_bytes(F.lit("F4")), dtypes.bits_per_element(F.lit("F6_E2M3")), dtypes.num_elements(F.array().cast("array<bigint>")), dtypes.parse_dtype(F.lit("nope")))
    assert list(r) == ["BF16", None, 6, 1, None]


def plain_stream(seed, n):
    mask = (1 << 64) - 1
    a, b = int.from_bytes(seed[:8], "little"), int.from_bytes(seed[8:16], "little")
    out = []
    for _ in range(n):
        out.append((a + b) & mask)
        mixed = (a ^ b ^ (b << 16) ^ (a >> 24)) & mask
        a, b = ((b << 24) | (b >> 40)) & mask, ((mixed << 37) | (mixed >> 27)) & mask
    return out


def test_streams_match_a_plain_generator():
    seeds = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    streams = generate.ShiftRegister(seeds)
    got = np.stack([streams.next_u64() for _ in range(50)], axis=1)
    assert [[int(x) for x in row] for row in got] == [plain_stream(s, 50) for s in seeds]


def test_stream_values_do_not_depend_on_partitioning(spark):
    t = spark.createDataFrame([("a", 0, 1000), ("b", None, 130)], "name string, layer int, elements long")
    chunks = generate.chunk_table(t, 100, "m", "v", 3)
    one_way = generate.stream_values(chunks).orderBy("name", "idx").collect()
    other = generate.stream_values(chunks, tasks=3).orderBy("name", "idx").collect()
    assert one_way == other and len(one_way) == 1130


def test_correlated_columns(spark):
    m = generate.correlated_columns(spark, 4000, 2, 0.8, 1.0, 5)
    r = linalg.correlation_matrix(m).filter("i < j").first()["corr"]
    assert abs(r - 0.64) < 0.05


def test_linear_algebra_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 5))
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(5)], "row long, col long, val double")
    sigma = [r["sigma"] for r in linalg.singular_values(m).collect()]
    assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False))
    s = a.T @ a
    cov = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(5) for j in range(5)], "row long, col long, val double")
    factor = linalg.cholesky(cov)
    assert linalg.reconstruction_error(factor, cov).first()["error"] < 1e-9
    with pytest.raises(ValueError):
        linalg.equicorrelation(spark, [3], [-0.9])


def test_ks_of_its_own_distribution(spark):
    df = generate.counter_values(spark.range(5000), distributions.Normal(3, 2), 11, "id", column="x")
    r = ordered.test_fit(df, "x", "normal").first()
    assert r["p"] > 0.01 and abs(r["mu"] - 3) < 0.15
    assert ordered.test_fit(df, "x", "student_t").first()["n"] == 5000


def test_codecs():
    x = np.array([0.0, 1.0, -2.5, 300.7, -1e9])
    for t in ("F64", "F32", "F16", "BF16"):
        assert np.allclose(numeric.decode(numeric._encode(x[:4], t), t), x[:4], rtol=1e-2)
    assert list(numeric.decode(numeric._encode(x, "I8"), "I8")) == [0, 1, -2, 127, -128]
    assert list(numeric.decode(bytes([0x38, 0x7E, 0xB8, 0x01]), "F8_E4M3")) == [1.0, 448.0, -1.0, 2.0**-9]
    assert list(numeric.decode(bytes([0x3C, 0x7B]), "F8_E5M2")) == [1.0, 57344.0]
    assert list(numeric.decode(bytes([127, 128]), "F8_E8M0")) == [1.0, 2.0]


def test_validation_bands(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0), ("b", 1.015, 1.0, 1.5, 1.0)], "path string, mean double, target_mean double, std double, target_std double")
    found = {(r["path"], r["severity"]) for r in validate.statistics(rows, "path", 0.01).collect()}
    assert found == {("b", "WARNING"), ("b", "ERROR")}
    assert "total" in validate.report(validate.statistics(rows, "path", 0.01)).first()["report"]


def test_transcript_with_tools_and_reasoning(spark):
    calls = [("c1", "f", '{"x": 1, "y": "é"}'), ("c2", "g", "not json")]
    rows = [
        (1, 0, "system", "S", None, None, None, None, ['{"name": "f"}']),
        (1, 1, "user", "Q", None, None, None, None, None),
        (1, 2, "assistant", "", "why", None, None, calls, None),
        (1, 3, "tool", "r2", None, None, "c2", None, None),
        (1, 4, "tool", "r1", None, None, "c1", None, None),
        (1, 5, "assistant", "A", "done", None, None, None, None),
        (2, 0, "user", "hi", None, None, None, None, None),
        (2, 1, "assistant", "yo", "old", None, None, None, None),
        (2, 2, "user", "again", None, None, None, None, None),
        (2, 3, "user", "more", None, None, None, None, None),
    ]
    schema = "conv_id long, turn long, role string, content string, reasoning string, task string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>, tools array<string>"
    got = {r["conv_id"]: r["text"] for r in transcripts.encode(spark.createDataFrame(rows, schema), thinking=True).collect()}
    m = transcripts.MARK
    assert got[2] == "<｜begin▁of▁sentence｜><｜User｜>hi<｜Assistant｜></think>yo<｜end▁of▁sentence｜><｜User｜>again\n\nmore<｜Assistant｜><think>"
    assert "<tool_result>r1</tool_result>\n\n<tool_result>r2</tool_result>" in got[1]
    assert f'<{m}parameter name="x" string="false">1</{m}parameter>\n<{m}parameter name="y" string="true">é</{m}parameter>' in got[1]
    completion = got[1].split("<｜Assistant｜><think>")[1].split("<｜User｜>")[0]
    parsed = transcripts.parse_completion(completion, True)
    assert parsed["reasoning"] == "why" and [c["name"] for c in parsed["tool_calls"]] == ["f", "g"]
    with pytest.raises(ValueError):
        transcripts.parse_completion("no end", False)
    texts = spark.createDataFrame([("ok<｜end▁of▁sentence｜>",), ("bad",), (None,)], "t string")
    errors = [r["error"] is None for r in transcripts.parse_completions(texts, "t").collect()]
    assert errors == [True, False, False]


def test_merging_stops_at_tasks(spark):
    rows = [(1, 0, "user", "a", "title"), (1, 1, "user", "b", None), (1, 2, "tool", "c", None), (1, 3, "user", "d", "query")]
    df = transcripts.with_defaults(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, task string"))
    merged = transcripts.merge_turns(df).orderBy("turn").collect()
    assert [[b["text"] for b in r["blocks"]] for r in merged] == [["a"], ["b", "c", "d"]]
    assert [r["task"] for r in merged] == ["title", None]
