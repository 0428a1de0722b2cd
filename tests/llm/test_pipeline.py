"""Pipeline stages on odd tables: repeated ids and rows, nulls, clashing columns, no rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = [f"w{i}" for i in range(500)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, item


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["own"]) for r in df.collect())


def test_stages_keep_what_they_should(spark, tables):
    folder, item = tables
    rng = random.Random(2)
    text = {k: " ".join(rng.choice(WORDS) for _ in range(60)) for k in "abcdefg"}
    rows = [(1, text["a"]), (1, text["a"]), (2, text["b"]), (5, text["a"]), (5, text["c"]), (None, text["d"]), (None, text["d"]), (7, None), (8, ""), (9, f"{text['e']} {item} x")]
    rows += [(10, "\n".join(text[k] for k in "fgf")), (11, "\n".join(text[k] for k in "fgf") + "\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.select("*", F.lit("mine").alias("own"), F.lit(1).alias("key"), F.lit(2).alias("n_removed"), F.lit(3.0).alias("score"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near duplicates"](spark, docs, folder)
    assert kept.columns == docs.columns
    expected = [(1, text["a"]), (2, text["b"]), (5, text["c"]), (None, text["d"]), (7, None), (8, ""), rows[9], rows[10]]
    assert rows_of(kept) == Counter((i, t, "mine") for i, t in expected)
    clean = stages["decontamination"](spark, kept, folder)
    assert clean.columns == docs.columns and rows_of(clean) == Counter((i, t, "mine") for i, t in expected if i != 9)
    lines = stages["line dedup"](spark, docs, folder)
    assert lines.columns == docs.columns and {r["n_removed"] for r in lines.collect()} == {2}
    assert (11, "last", "mine") in rows_of(lines) and (10, rows[10][1], "mine") in rows_of(lines) and lines.filter("doc_id = 5").count() == 2
    left = stages["toxicity"](spark, docs, folder)
    assert left.columns == docs.columns and rows_of(left) <= rows_of(docs)
    pieces = stages["packing"](spark, docs, folder)
    assert pieces.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_stages_on_no_rows(spark, tables):
    folder, _ = tables
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        assert done.count() == 0 and (name == "packing" or done.columns == docs.columns), name
