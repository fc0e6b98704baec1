"""A set of rows that grows by levels, kept in buckets as runs that are merged by tiers.

Rows are dealt to buckets by a hash of their key.  Each level adds one run to the
buckets that it touches; when a bucket has FAN_OUT runs of one tier they are
rewritten as one of the next.  Whoever asks which of some keys are in the set
reads the buckets of those keys only, each of which has few runs, so that a
small level stays a small read however many levels were before it.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.plans import storage

FAN_OUT = 8


class Runs:
    """Rows by ``key`` columns; the driver knows the runs of each bucket by name."""

    def __init__(self, spark: SparkSession, name: str, key: list[str], buckets: int):
        self.spark, self.key, self.buckets, self.path = spark, key, buckets, storage.new_path(spark, name)
        self.schema, self.n = None, 0
        #: by bucket, by tier: the folders of its runs
        self.runs: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        self.merged: list[str] = []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows with their bucket, each bucket in one task."""
        return df.withColumn("bucket", self.bucket()).repartition("bucket")

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Store rows (with bucket), a folder for each bucket: those folders."""
        path, self.n = f"{self.path}/{self.n}", self.n + 1
        df.write.partitionBy("bucket").parquet(path)
        return {int(name.split("=")[1]): f"{path}/{name}" for name in storage.children(self.spark, path) if name.startswith("bucket=")}

    def extend(self, df: DataFrame) -> DataFrame:
        """Store rows as a run of each of their buckets; those of them whose keys no earlier run has.

        Rows of keys that are there already are stored too: the set stays the
        same, and one write does for both.  The result is to be read before the
        next call, which removes runs that have been merged.
        """
        for folder in self.merged:
            storage.delete(self.spark, folder)
        self.merged = []
        self.schema = df.schema
        made = self._write(self.dealt(df))
        known = self.folders(list(made))
        rows = self.read(list(made.values()))
        fresh = rows.join(self.read(known).select(*self.key), self.key, "left_anti") if known else rows
        for bucket, folder in made.items():
            self.runs[bucket][0].append(folder)
        self._merge()
        return fresh

    def _merge(self) -> None:
        tier = 0
        while full := [b for b, tiers in self.runs.items() if len(tiers[tier]) >= FAN_OUT]:
            made = self._write(self.read([f for b in full for f in self.runs[b][tier]]).withColumn("bucket", self.bucket()).repartition("bucket"))
            for b in full:
                self.merged += self.runs[b].pop(tier)
                self.runs[b][tier + 1].append(made[b])
            tier += 1

    def read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def folders(self, buckets: list[int] | None = None) -> list[str]:
        """Of some buckets, or all."""
        return [f for b in (self.runs if buckets is None else buckets) if b in self.runs for tier in self.runs[b].values() for f in tier]

    def all(self) -> DataFrame:
        return self.read(self.folders())
