"""Incremental runs over arriving rows (inventory F27, N1-N9) and event-time extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_statistics(stream: DataFrame, column: str, *by: str) -> DataFrame:
    """Exact moments as mergeable sums: n, mean, variance, least and most of all rows so far."""
    x = F.col(column).cast("double")
    return stream.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"), F.min(x).alias("least"), F.max(x).alias("most"))


def tumbling(stream: DataFrame, time: str, size: str, lateness: str, column: str, *by: str) -> DataFrame:
    """Extra: counts and sums by event-time window; later rows than the watermark are dropped."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(column).alias("total")).select("w.start", "w.end", *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, *by: str) -> DataFrame:
    """Extra: sessions that end after a gap."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, each row once, until the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run to the end of the input into a table in memory (tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
