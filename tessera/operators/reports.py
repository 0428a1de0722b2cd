"""Reports as text and JSON columns (inventory H1, M19-M25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.formats import format_bytes, format_number


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def console(tally: DataFrame) -> DataFrame:
    """One line for each row of counts."""
    state = F.when(F.col("valid"), "valid").otherwise("invalid")
    text = F.format_string("%s: %d issues (%d critical, %d errors, %d warnings, %d notes), score %.3f", state, F.col("n_issues"), F.col("n_critical"), F.col("n_error"), F.col("n_warning"), F.col("n_info"), F.col("score"))
    return tally.withColumn("text", text)


def validation_text(issues: DataFrame, *by: str, score: bool = False) -> DataFrame:
    """A text report of each group: head, issues by severity, optional score."""
    from tessera.operators.validate import severity_rank, tally

    item = F.struct((-severity_rank(F.col("severity"))).alias("r"), "path", F.format_string("[%s] %s %s: %s", "severity", "category", "path", "message").alias("t"))
    listed = issues.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("i"))
    counts = console(tally(issues, *by)).select(*by, F.col("text").alias("head"), "score")
    joined = listed.join(counts, list(by)) if by else listed.crossJoin(counts)
    tail = [F.format_string("score: %.4f", "score")] if score else []
    return joined.select(*by, _lines("Validation", F.col("head"), F.array_join("i.t", "\n"), *tail).alias("text"))


def comparison_text(row: DataFrame) -> DataFrame:
    """Scores of a comparison, one line each."""
    names = [c for c, t in row.dtypes if t == "double"]
    return row.select(_lines("Comparison", *[F.format_string(f"{n}: %.4f", n) for n in names], F.concat(F.lit("status: "), "status")).alias("text"))


def comparison_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def inspection_text(structure: DataFrame, physical: DataFrame) -> DataFrame:
    """Structure and size of a model in a few lines; one row each."""
    both = structure.crossJoin(physical)
    return both.select(
        _lines(
            F.concat(F.lit("tensors: "), format_number(F.col("tensors"))), F.concat(F.lit("elements: "), format_number(F.col("elements"))),
            F.concat(F.lit("layers: "), F.col("layers").cast("string")), F.concat(F.lit("bytes: "), format_bytes(F.col("bytes"))), F.concat(F.lit("main type: "), "main_dtype"),
        ).alias("text")
    )


def first_tensors(catalogue: DataFrame, n: int = 10) -> DataFrame:
    """The first tensors in order of path and name."""
    return catalogue.orderBy("path", "name").limit(n)
