"""The search log as a stream: searches counted by window, late entries within the watermark included. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.schema import SEARCH_LOG


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SEARCH_LOG).parquet(path)


def searches_by_window(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, n, mean_ms, max_ms) of each window of event time."""
    grouped = log.withWatermark("timestamp", late).groupBy(F.window("timestamp", window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg("duration").alias("mean_ms"), F.max("duration").alias("max_ms")).select("w.start", "w.end", "n", "mean_ms", "max_ms")
