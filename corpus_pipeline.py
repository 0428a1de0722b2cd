"""Corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Defined results of all stages: rows are judged one by one, so ids may repeat
or be null; null texts are empty and stay; an empty table gives no rows; extra
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, minhash, packing, quality, toxicity
from tessera.llm.runtime import delete, materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more for toxicity go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"), quality.fold(4) != 2)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document of which nothing is left goes too."""
    count = "_lines_removed"
    done = line_dedup.dedup_lines(docs, count=count)
    left = done.filter((F.col(count) == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*[(n_chars if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five words, similarity 0.8)."""
    return minhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Toxicity scores come from a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token sequences of ``documents`` after all stages."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last:
            delete(spark, last)  # what it was made from is no longer needed
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
