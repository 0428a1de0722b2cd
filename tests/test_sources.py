import json
import os
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessera.plans import models
from tessera.sources import safetensors as st
from tessera.streaming import incremental


def tensor(name, dtype, shape):
    from tessera.functions.dtypes import DTYPES

    return name, dtype, shape, bytes(int(np.prod(shape)) * DTYPES[dtype][0])


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a": [tensor("weight", "F32", [2, 3])],
        "b": [tensor("weight", "F32", [2, 3])],
        "c": [tensor("weight", "F32", [3, 4])],
        "d": [tensor("weight", "F32", [2, 3]), tensor("bias", "F32", [3])],
        "e": [tensor("embedding", "F16", [10, 5])],
        "f": [tensor("bias", "F32", [2, 3])],
    }
    for name, tensors in files.items():
        (tmp_path / f"{name}.safetensors").write_bytes(st.file_bytes(tensors))
    return tmp_path


def test_headers_and_comparisons(spark, folder):
    def scores(x, y):
        r = models.compare_models(spark, str(folder / f"{x}.safetensors"), str(folder / f"{y}.safetensors")).first()
        return r["tensors"], r["shapes"], r["status"]

    assert scores("a", "b")[0] == 1.0
    assert scores("a", "c")[:2] == (1.0, 0.0)
    assert scores("a", "d")[0] == 0.5
    assert scores("a", "e")[0] == 0.0 and scores("a", "f")[0] == 0.0
    c = models.catalogue(spark, str(folder))
    assert c.count() == 7
    other = {tuple(r) for r in st.headers_from_binary(spark, str(folder)).select("name", "dtype", "begin", "end").collect()}
    assert other == {tuple(r) for r in c.select("name", "dtype", "begin", "end").collect()}


@pytest.mark.parametrize("raw", [b"", b"x", bytes(8), b"\xff" * 64, struct.pack("<Q", 100) + b"{}", struct.pack("<Q", 2) + b"[]", struct.pack("<Q", 2) + b'""', struct.pack("<Q", 3) + b"{x}"])
def test_corrupt_files(spark, tmp_path, raw):
    (tmp_path / "x.safetensors").write_bytes(raw)
    st.register(spark)
    with pytest.raises(PySparkException):
        spark.read.format("safetensors").load(str(tmp_path)).collect()
    assert spark.read.format("safetensors").option("corrupt", "skip").load(str(tmp_path)).count() == 0


def test_bad_entries_are_skipped_or_rejected(spark, tmp_path):
    header = json.dumps({"__metadata__": {"a": "b"}, "good": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}, "odd": {"dtype": "??", "shape": [1], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + bytes(4))
    st.register(spark)
    assert [r["name"] for r in spark.read.format("safetensors").load(str(tmp_path)).collect()] == ["good"]
    with pytest.raises(PySparkException):
        spark.read.format("safetensors").option("mode", "strict").load(str(tmp_path)).collect()


def test_round_trip_of_values(spark, tmp_path):
    x = np.arange(12, dtype="<f4")
    rows = [("t1", "F32", [3, 4], bytearray(x.tobytes()[:20])), ("t1", "F32", [3, 4], bytearray(x.tobytes()[20:])), ("t2", "I8", [2], bytearray(b"\x01\xff"))]
    st.register(spark)
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<long>, payload binary").coalesce(1)
    df.write.format("safetensors").mode("overwrite").save(str(tmp_path / "m"))
    values = spark.read.format("safetensors_values").option("chunk", 5).load(str(tmp_path / "m"))
    got = {n: [r["val"] for r in values.filter(values.name == n).orderBy("idx").collect()] for n in ("t1", "t2")}
    assert got == {"t1": x.tolist(), "t2": [1.0, -1.0]}
    index = json.loads((tmp_path / "m" / "model.safetensors.index.json").read_text())
    assert set(index["weight_map"]) == {"t1", "t2"} and index["metadata"]["total_size"] == 50


def test_generate_inspect_validate(spark, tmp_path):
    path = str(tmp_path / "g")
    models.generate(spark, path, 2, 32, 4, 64, 100, 1)
    first = sorted(r["payload"] for r in models.tensor_payloads(spark, models.catalog.blueprint(spark, 1, 32, 4, 4, 64, 100), 1).collect())
    again = sorted(r["payload"] for r in models.tensor_payloads(spark, models.catalog.blueprint(spark, 1, 32, 4, 4, 64, 100), 1).collect())
    assert first == again
    tables = models.inspect(spark, path)
    row = tables["structure"].first()
    assert row["tensors"] == 3 + 9 * 2 and row["layers"] == 2
    assert tables["config"].first()["attention"] == "Dense"
    assert models.config_issues(tables["config"]).count() == 0
    assert models.validate_files(spark, path).count() == 0


def test_running_statistics_over_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id % 2 AS g", "double(id) AS x", "timestamp_seconds(id * 60) AS t").coalesce(1).write.mode("append").parquet(source)
    stream = incremental.file_stream(spark, source, "g long, x double, t timestamp")
    incremental.to_memory(incremental.running_statistics(stream, "x", "g"), "running")
    batch = {r["g"]: r for r in incremental.running_statistics(spark.read.parquet(source), "x", "g").collect()}
    got = {r["g"]: r for r in spark.table("running").collect()}
    assert got.keys() == batch.keys() and all(got[g]["n"] == batch[g]["n"] and got[g]["var_pop"] == pytest.approx(batch[g]["var_pop"]) for g in got)
    windows = incremental.tumbling(incremental.file_stream(spark, source, "g long, x double, t timestamp"), "t", "10 minutes", "1 minute", "x")
    incremental.to_memory(windows, "windows", "append")
    assert spark.table("windows").count() >= 1
    query = incremental.append_to(incremental.file_stream(spark, source, "g long, x double, t timestamp"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30 and os.path.isdir(tmp_path / "state")


def test_remote_headers_with_cache(spark, folder, tmp_path):
    import http.server
    import threading

    from tessera.sources import remote

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            raw = (folder / self.path.strip("/")).read_bytes()
            asked = self.headers.get("Range")
            if not asked or self.path.startswith("/b"):  # b ignores ranges
                self.send_response(200)
                self.end_headers()
                self.wfile.write(raw)
                return
            lo, hi = map(int, asked.removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {lo}-{hi}/{len(raw)}")
            self.end_headers()
            self.wfile.write(raw[lo : hi + 1])

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(remote.RemoteSafetensors)
    reader = spark.read.format("safetensors_http").option("cache", str(tmp_path / "cache"))
    rows = reader.load(f"{base}/a.safetensors,{base}/d.safetensors").collect()
    assert sorted(r["name"] for r in rows) == ["bias", "weight", "weight"]
    assert not remote.supports_ranges(f"{base}/b.safetensors") and remote.supports_ranges(f"{base}/a.safetensors")
    server.shutdown()
    cache = remote.Cache(str(tmp_path / "cache"))
    assert remote.remote_header(f"{base}/a.safetensors", cache)["file_size"] == rows[0]["file_size"]
    assert cache.drop(f"{base}/a.safetensors") and not cache.drop(f"{base}/a.safetensors")


def test_profiles_and_manifests(spark, tmp_path):
    from tessera.sources import profiles

    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "outlier_config": {"probability": 1.5, "severity_factor": 2.0}, "low_rank_config": {"rank_ratio": 0.5}}))
    assert [r["problem"] for r in profiles.statistical_problems(profiles.statistical_profiles(spark, str(tmp_path / "p.json"))).collect()] == ["outlier_config.probability is not in [0, 1]"]
    (tmp_path / "m.json").write_text(json.dumps({"model_type": "t", "hidden_size": 10, "num_attention_heads": 3, "num_hidden_layers": 1, "vocab_size": 5, "tensor_patterns": ["a"]}))
    assert [r["problem"] for r in profiles.model_problems(profiles.model_profiles(spark, str(tmp_path / "m.json"), "t")).collect()] == ["heads do not divide hidden_size"]
    plan = models.catalog.blueprint(spark, 1, 32, 4, 4, 64, 100)
    text = profiles.manifest_json(plan, "m", 1, "v").first()["json"]
    (tmp_path / "f.json").write_text(text)
    back = profiles.read_json(spark, str(tmp_path / "f.json"), profiles.MANIFEST)
    assert profiles.manifest_problems(back).count() == 0 and profiles.manifest_rows(back).count() == 12
    chunks = spark.createDataFrame([(0, 0, 5), (1, 5, 9), (2, 10, 12)], "chunk_id long, start long, end long")
    assert [r["problem"] for r in profiles.chunk_problems(chunks, 12).collect()] == ["gap or overlap"]
    fields = spark.createDataFrame([("a", "Unknown", "Exact"), ("b", "Observed", "Exact")], "name string, origin string, confidence string")
    assert profiles.origin_problems(fields).count() == 1


def test_reports(spark, folder):
    from tessera.operators import reports, validate

    c = models.catalogue(spark, str(folder))
    text = reports.inspection_text(models.catalog.structure(c), models.catalog.physical(c)).first()["text"]
    assert "tensors: 7" in text
    issues = spark.createDataFrame([("OUTLIER", "ERROR", "m", "p"), ("OUTLIER", "INFO", "n", "q")], "category string, severity string, message string, path string")
    report = reports.validation_text(issues, score=True).first()["text"]
    assert report.startswith("Validation\ninvalid: 2 issues") and report.index("[ERROR]") < report.index("[INFO]")
    row = models.compare_models(spark, str(folder / "a.safetensors"), str(folder / "b.safetensors"))
    assert "status: MATCH" in reports.comparison_text(row).first()["text"] and "percent" in reports.comparison_json(row).first()["json"]
    assert validate.tally(issues).first()["valid"] is False and reports.first_tensors(c, 3).count() == 3
