"""Path cache, search log and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.functions import first_path_vertices
from pathweave.operators import bfs
from pathweave.operators.blocks import Blocks
from pathweave.plans import storage
from pathweave.plans.storage import stored
from pathweave.schema import PATH_CACHE

#: Buckets of a stored cache, and the files of one from which on it is rewritten.
BUCKETS, FILES = 64, 8


class PathCache:
    """Cache rows under a path, a folder for each bucket of pairs.

    New rows of a pair are added beside the old ones, and the latest counts; a
    bucket of more than FILES files is rewritten as one, with the latest rows
    only.  The new file is in place before the old ones go, so that a reader or
    a rewriting that breaks off meets a row twice at worst.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, source: str = "source_page_id", target: str = "target_page_id") -> Column:
        return F.pmod(F.xxhash64(source, target), F.lit(self.buckets)).cast("int")

    def _folders(self) -> dict[int, str]:
        return {int(name.split("=")[1]): f"{self.path}/{name}" for name in storage.children(self.spark, self.path) if name.startswith("bucket=")}

    def rows(self, pairs: DataFrame | None = None) -> DataFrame:
        """Rows of the buckets of ``pairs`` (source_id, target_id), or all."""
        folders = self._folders()
        if pairs is not None and folders:
            # as many rows as buckets
            wanted = {r.b for r in pairs.select(self._bucket("source_id", "target_id").alias("b")).distinct().collect()}
            folders = {b: f for b, f in folders.items() if b in wanted}
        return self.spark.read.schema(PATH_CACHE).parquet(*folders.values()) if folders else self.spark.createDataFrame([], PATH_CACHE)

    def add(self, rows: DataFrame) -> None:
        """Add rows, and rewrite the buckets that have become many files."""
        rows.select(*PATH_CACHE.names, self._bucket().alias("bucket")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        self.compact(FILES)

    def compact(self, more_than: int = 1) -> None:
        """Rewrite the buckets of more than so many files."""
        files = {f: [x for x in storage.children(self.spark, f) if x.startswith("part-")] for f in self._folders().values()}
        full = {f: names for f, names in files.items() if len(names) > more_than}
        if not full:
            return
        beside = storage.new_path(self.spark, "cache")
        old = self.spark.read.schema(PATH_CACHE).parquet(*[f"{f}/{name}" for f, names in full.items() for name in names])
        latest(old).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(beside)
        for name in storage.children(self.spark, beside):
            if name.startswith("bucket="):
                for part in storage.children(self.spark, f"{beside}/{name}"):
                    if part.startswith("part-"):
                        storage.replace(self.spark, f"{beside}/{name}/{part}", f"{self.path}/{name}/{part}")
        for f, names in full.items():
            for name in names:
                storage.delete(self.spark, f"{f}/{name}")
        storage.delete(self.spark, beside)


def cache_rows(pairs: DataFrame, paths: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Rows for the cache: all paths of a pair as JSON, ascending; a pair without paths has an empty list."""
    found = paths.groupBy("source_id", "target_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    rows = pairs.select("source_id", "target_id").distinct().join(found, ["source_id", "target_id"], "left")
    return rows.select(
        F.col("source_id").alias("source_page_id"), F.col("target_id").alias("target_page_id"), F.current_timestamp().alias("timestamp"),
        F.lit(float(seconds)).alias("duration"), F.to_json(F.coalesce("paths", F.array().cast("array<array<bigint>>"))).alias("path_data"))


def latest(cache: DataFrame) -> DataFrame:
    """The last row of each pair."""
    order = Window.partitionBy("source_page_id", "target_page_id").orderBy(F.desc("timestamp"), "path_data")
    return cache.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def hits(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs with their cached paths (array)."""
    wanted = pairs.select(F.col("source_id").alias("source_page_id"), F.col("target_id").alias("target_page_id"))
    own = cache.join(wanted, ["source_page_id", "target_page_id"], "left_semi")
    rows = latest(own).select(F.col("source_page_id").alias("source_id"), F.col("target_page_id").alias("target_id"), F.from_json("path_data", "array<array<bigint>>").alias("paths"))
    return pairs.join(rows, ["source_id", "target_id"]).select("source_id", "target_id", "paths")


def misses(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select(F.col("source_page_id").alias("source_id"), F.col("target_page_id").alias("target_id"))
    return pairs.select("source_id", "target_id").distinct().join(known, ["source_id", "target_id"], "left_anti")


def cached_paths(pairs: DataFrame, graph: DataFrame | Blocks, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths of all pairs, new cache rows): only pairs that are not cached are searched, once; without such pairs no graph is read."""
    new = stored(misses(pairs, cache), "misses")
    known = hits(pairs, cache).select("source_id", "target_id", F.explode("paths").alias("path"))
    if new.isEmpty():
        return known, cache_rows(new, known.limit(0))
    found = stored(bfs.shortest_paths(new, graph), "found")
    return known.unionByName(found), cache_rows(new, found)


def long_paths(cache: DataFrame, vertexes: DataFrame, least: int = 5, limit: int = 20) -> DataFrame:
    """Cached pairs whose first path has ``least`` vertices or more, the longest first."""
    rows = latest(cache).select("source_page_id", "target_page_id", first_path_vertices(F.col("path_data")).alias("first_path_vertices")).filter(F.col("first_path_vertices") >= least)
    s = vertexes.select(F.col("id").alias("source_page_id"), F.col("title").alias("source_title"))
    t = vertexes.select(F.col("id").alias("target_page_id"), F.col("title").alias("target_title"))
    return rows.join(s, "source_page_id").join(t, "target_page_id").select("source_title", "target_title", "first_path_vertices").orderBy(
        F.desc("first_path_vertices"), "source_title", "target_title").limit(limit)


def search_log_stats(log: DataFrame) -> DataFrame:
    """(source_page_id, n, n_targets, mean_ms, max_ms) of the search log."""
    return log.groupBy("source_page_id").agg(
        F.count("*").alias("n"), F.countDistinct("target_page_id").alias("n_targets"), F.avg("duration").alias("mean_ms"), F.max("duration").alias("max_ms"))
