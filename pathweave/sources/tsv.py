"""Adjacency text: a vertex id, a tab, its out-neighbours separated by commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(id, outgoing) of a TSV file."""
    rows = spark.read.csv(path, sep="\t", schema="id bigint, neighbours string")
    ids = F.filter(F.split("neighbours", ","), lambda x: x != "")
    return rows.select("id", F.coalesce(F.transform(ids, lambda x: x.cast("bigint")), F.array().cast("array<bigint>")).alias("outgoing"))


def edges_of(adjacency: DataFrame) -> DataFrame:
    return adjacency.select(F.col("id").alias("src"), F.explode("outgoing").alias("dst"))
