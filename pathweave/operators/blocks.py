"""Neighbour lists in blocks of bounded length, dealt to buckets: what searches and point reads see of a graph.

A block holds some neighbours of a vertex on one side (f: where its links go, b:
where they come from), ascending and each once, with their numbers of links.
The next block of the same side goes on where it ends, so that a vertex of any
number of links is many rows, which lie in different buckets and are built and
read by different tasks.

Vertex, side and part make one number, the slot, by which blocks are bucketed
and sorted.  A join of a frontier with the blocks moves the frontier only, and a
lookup of given slots reads their buckets and, of these, the row groups that
hold them.  Lists are written with Parquet's delta encoding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.plans import storage

#: Neighbours of a block.
BLOCK = 4096
_SIDE, _VERTEX = 1 << 24, 1 << 25
#: Ids from here on do not fit a slot.
LARGEST_ID = 1 << 38
#: Lookups of at most this many slots name them, so that other buckets and row groups are skipped.
FEW = 1_000
#: Bytes of blocks up to which they are read whole.
SMALL = 8 << 20
SCHEMA = "slot bigint, side string, v bigint, part int, parts int, links bigint, w array<bigint>, times array<bigint>"


def slot(v: Column, side: Column, part: Column) -> Column:
    return v * _VERTEX + F.when(side == "b", _SIDE).otherwise(0) + part


def ways(edges: DataFrame) -> DataFrame:
    """(side, v, w, times): the links of a vertex to another, counted; partial counts come before the shuffle."""
    both = F.array(
        F.struct(F.lit("f").alias("side"), F.col("src").alias("v"), F.col("dst").alias("w")),
        F.struct(F.lit("b").alias("side"), F.col("dst").alias("v"), F.col("src").alias("w")))
    known = edges.filter("src is not null and dst is not null").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    return known.groupBy("src", "dst").agg(F.count("*").alias("times")).select(F.explode(both).alias("x"), "times").select("x.*", "times")


def blocks_of(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of a graph.

    Ways are dealt to ranges of (v, side, w), which cut a vertex of many links
    into runs of a task's size; a run is cut into blocks, numbered after those
    of the runs before it.
    """
    whole = "v", "side"
    # the range of a row is fixed by storing it
    runs = storage.stored(ways(edges).repartitionByRange("v", "side", "w").withColumn("run", F.spark_partition_id()), "runs")
    n_blocks = F.ceil(F.col("n") / block)
    every, before = Window.partitionBy(*whole), Window.partitionBy(*whole).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # a vertex has as many runs as there are ranges at most
    spans = runs.groupBy(*whole, "run").agg(F.count("*").alias("n"), F.sum("times").alias("links")).select(
        *whole, "run", F.coalesce(F.sum(n_blocks).over(before), F.lit(0)).alias("first"), F.sum(n_blocks).over(every).cast("int").alias("parts"), F.sum("links").over(every).alias("links"))
    number = F.row_number().over(Window.partitionBy(*whole, "run").orderBy("w"))
    cut = runs.withColumn("chunk", F.floor((number - 1) / block)).groupBy(*whole, "run", "chunk").agg(F.sort_array(F.collect_list(F.struct("w", "times"))).alias("x"))
    times = F.when(~F.forall("x", lambda x: x["times"] == 1), F.col("x.times"))
    fits = F.when(F.abs("v") < LARGEST_ID, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("no room in a slot for id "), F.col("v").cast("string"))))
    return cut.join(spans, [*whole, "run"]).withColumn("part", (F.col("first") + F.col("chunk")).cast("int")).select(
        slot(fits, F.col("side"), F.col("part")).alias("slot"), "side", "v", "part", "parts", "links", F.col("x.w").alias("w"), times.alias("times"))


class Blocks:
    """Stored blocks."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.rows, self.buckets, self.n_bytes = rows, buckets, None

    @property
    def degrees(self) -> DataFrame:
        """(slot, side, v, parts, links) of every vertex side that has links: the index of its parts."""
        return self.rows.filter("part = 0").select("slot", "side", "v", "parts", "links")

    def edges(self) -> DataFrame:
        """(src, dst) without repeats."""
        return self.rows.filter("side = 'f'").select(F.col("v").alias("src"), F.explode("w").alias("dst"))

    def at(self, slots: Iterable[int] | None) -> DataFrame:
        """The blocks of some slots, or all."""
        return self.rows if slots is None else self.rows.filter(F.col("slot").isin(sorted(set(slots))))

    def joined(self, left: DataFrame, slots: Iterable[int] | None, *columns: str, how: str = "inner") -> DataFrame:
        """``left``, which has a column slot, with columns of its blocks; only ``left`` is moved. ``slots``, if they are few, are those of ``left``."""
        return left.repartition(self.buckets, "slot").join(self.at(slots).select("slot", *columns), "slot", how)

    def few(self, rows: DataFrame, at_most: int) -> list[int] | None:
        """The slots of rows (slot) that are known to be few; None if they are more, or the blocks so small that reading all takes less than naming some."""
        if self.n_bytes is None:
            self.n_bytes = int(self.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if at_most > FEW or self.n_bytes < SMALL:
            return None
        return [r.slot for r in rows.select("slot").distinct().limit(FEW + 1).collect()]

    def neighbours(self, v: int) -> DataFrame:
        """(side, part, w) of one vertex, read part by part: the first block of a side tells how many there are."""
        first = [v * _VERTEX, v * _VERTEX + _SIDE]
        found = {r.slot: r.parts for r in self.at(first).select("slot", "parts").collect()}
        if sum(found.values()) <= FEW:
            rows = self.at([s + i for s, parts in found.items() for i in range(parts)] or first)
        else:
            rows = self.rows.filter(F.col("slot").between(first[0], first[0] + _VERTEX - 1))
        return rows.select("side", "part", "w")


def write(blocks: DataFrame, path: str, buckets: int) -> None:
    """Store blocks at ``path``, a file for each bucket, sorted by slot."""
    spark, name = blocks.sparkSession, f"pathweave_{uuid.uuid4().hex}"
    blocks.repartition(buckets, "slot").write.format("parquet").mode("overwrite").bucketBy(buckets, "slot").sortBy("slot").option("path", path).option(
        "parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#w.list.element", "false").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry: the files are the table's owner's


def read(spark: SparkSession, path: str, buckets: int) -> Blocks:
    """Blocks stored at ``path``. Spark knows buckets of tables only, so one is declared until it is resolved."""
    name = f"pathweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return Blocks(spark.table(name), buckets)
    finally:
        spark.sql(f"DROP TABLE {name}")


def build(edges: DataFrame, path: str | None = None, buckets: int | None = None, block: int = BLOCK) -> Blocks:
    """Blocks of ``edges``, stored at ``path`` or in the scratch folder."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or storage.new_path(spark, "blocks")
    write(blocks_of(edges, block), path, buckets)
    return read(spark, path, buckets)
