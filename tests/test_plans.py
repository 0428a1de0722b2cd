"""Plans are the ones we want: pruned scans, pushed filters, no cartesian products, no Python where none is needed."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, formats, names
from tessera.operators import catalog, generate, linalg, ordered, stats
from tessera.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
PYTHON = {"g_ks_student_t", "c_special", "j_gram", "j_correlation", "j_off_diagonal", "j_singular_values", "k_stream", "q_encode", "b_shard_plan"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_no_cartesian_products_and_no_needless_python(spark, name):
    text = plan(core.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert bool(re.search("Python|Pandas|ArrowEval|InArrow", text)) == (name in PYTHON)


#: Queries that join rows with a table of one row: moments of the whole table, a limit, counts of shards.
ONE_ROW = {"d_outliers_compat", "d_outliers_quantile", "g_super_weights", "e_sharding"}


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_no_nested_loops_and_no_windows_over_whole_tables(spark, name):
    text = plan(core.QUERIES[name](spark, DATA))
    assert ("NestedLoop" in text) == (name in ONE_ROW)
    for order in re.findall(r"windowspecdefinition\(([^,()]*)", text):
        assert not re.search("ASC|DESC", order) or order.startswith("_bucket#")  # sums of buckets are few


def test_scans_read_only_what_they_need(spark):
    text = plan(core.QUERIES["f_summary"](spark, DATA))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text
    assert text.count("Exchange ") == 1
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").filter(F.col("l_quantity") > 45)
    assert "GreaterThan(l_quantity,45.0)" in plan(stats.norms(lines, "l_tax", "l_linestatus"))


def test_roll_ups_shuffle_once(spark):
    assert plan(core.QUERIES["f_rollups"](spark, DATA)).count("Exchange ") == 1


def test_capped_hits_limit_before_the_shuffle(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    text = plan(ordered.capped_hits(e, F.col("value") > 0, "event_id", 3, "event_type"))
    assert text.count("WindowGroupLimit") == 2


def test_value_buckets_rise_with_values(spark):
    xs = [-1e300, -3.5, -1.0, -1e-300, 0.0, 1e-308, 0.1, 0.999999999, 1.0, 1.0000001, 2.0, 2.5, 1e9, 1e300]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered.value_bucket(F.col("x")).alias("b")).orderBy("x").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 8


def test_ranks_over_buckets_match_plain_ranks(spark):
    df = generate.counter_values(spark.range(3000), distributions.Laplace(0, 3), 5, "id", column="x").withColumn("x", F.round("x", 1))
    got = {r["x"]: (r["before"], r["upto"], r["n"]) for r in ordered.ranked_counts(df, "x").collect()}
    values = sorted(r["x"] for r in df.collect())
    assert all(got[v] == (values.index(v), 3000 - values[::-1].index(v), 3000) for v in set(values))


def test_names_and_small_formats(spark):
    r = spark.range(1).select(
        names.routed_expert(F.lit(3), F.lit(7), "gate", numbered=True), names.routed_expert(F.lit(3), F.lit(7), "up"), names.shared_expert(F.lit(1), "down"),
        formats.parse_codec(F.lit("ZSTANDARD")), formats.reduction_percent(F.lit(200), F.lit(50)), formats.compression_ratio(F.lit(0), F.lit(5)), formats.throughput_mib(F.lit(1 << 20), F.lit(0.5)), formats.parse_mode(F.lit("STRESS")),
    ).first()
    assert list(r) == ["layers.3.ffn.experts.7.w3.weight", "model.layers.3.mlp.experts.7.up_proj.weight", "model.layers.1.mlp.shared_experts.down_proj.weight", "zstd", 75.0, 0.0, 2.0, "Stress"]
    assert spark.createDataFrame([("abc",), ("é",)], "n string").agg(formats.header_reserve(F.col("n"))).first()[0] == 65536 + 256 + 5


def test_amplitudes_masks_and_maps(spark):
    df = spark.range(6).select(F.col("id").alias("idx"), F.lit(1.0).alias("val"))
    specs = spark.createDataFrame([(0, "add", 2.0), (1, "multiply", 0.5)], "ord long, kind string, amount double")
    got = [r["val"] for r in generate.round_robin_amplitudes(df, F.col("idx") % 2 == 1, specs).orderBy("idx").collect()]
    assert got == [1.0, 3.0, 1.0, 1.5, 1.0, 1.0]
    g = generate.grid(spark, 6, 6)
    counts = {k: g.filter(generate.sparse_mask(k, 6, 6, 2)).count() for k in ("rows", "columns", "diagonal_band", "single_block", "grid")}
    assert counts == {"rows": 18, "columns": 18, "diagonal_band": 24, "single_block": 4, "grid": 20}
    plan_rows = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "name string, bytes long")
    row = catalog.weight_map(catalog.shard_plan(plan_rows, 10)).first()
    assert row["weight_map"] == {"a": "model-00001-of-00002.safetensors", "b": "model-00002-of-00002.safetensors", "c": "model-00002-of-00002.safetensors"} and row["total_size"] == 12


def test_moments_survive_large_means(spark):
    m = generate.grid(spark, 4000, 2).withColumn("val", 1e9 + F.when(F.col("col") == 0, F.col("row") % 7).otherwise(F.col("row") % 7 * 2 + F.col("row") % 3)).repartition(5)
    r = linalg.correlation_matrix(m).filter("i < j").first()["corr"]
    wide = m.groupBy("row").agg(F.max(F.when(F.col("col") == 0, F.col("val") - 1e9)).alias("a"), F.max(F.when(F.col("col") == 1, F.col("val") - 1e9)).alias("b"))
    assert abs(r - wide.agg(F.corr("a", "b")).first()[0]) < 1e-9


def test_shard_plan_by_ranges_matches_a_plain_fold(spark):
    rng = random.Random(3)
    for most in (50, 7, 100_000):
        rows = [(f"t{rng.randrange(400):03}", rng.choice([0, 0, 1, 3, 10, 49, 50, 51, 120])) for _ in range(500)] + [(None, 5), ("t9", None)]
        expected, shard, used = [], 1, 0
        for name, size in sorted((n or "", b or 0) for n, b in rows):
            if used and used + size > most:
                shard, used = shard + 1, 0
            used += size
            expected.append((name, size, shard))
        df = spark.createDataFrame(rows, "name string, bytes long")
        for range_rows in (1000, 40, 7):
            got = catalog.shard_plan(df, most, range_rows).collect()
            assert sorted((r["name"] or "", r["bytes"], r["shard"]) for r in got) == sorted(expected)
            assert all(r["too_large"] == (r["bytes"] > most) for r in got)
        assert catalog.shard_plan(df.limit(0), most).count() == 0
