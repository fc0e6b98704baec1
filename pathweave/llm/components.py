"""Connected components by alternating large-star and small-star steps.

Only DataFrame joins and grouped minima: a vertex of very many neighbours costs
a row a task before the shuffle, and joins on it may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm import scratch

#: A guard, not a limit: rounds grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # edges hold u > v: the least neighbour of u gets u and its other neighbours
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that stands in an edge (a, b); component is the least id that can be reached."""
    return stored_components(edges)[0]


def stored_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """As components(), and the path of its table for scratch.remove()."""
    spark = edges.sparkSession
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = scratch.stored(now, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        step, later = scratch.stored(_small_star(_large_star(now).filter("u <> v").distinct()).filter("u <> v").distinct(), "edges")
        scratch.remove(spark, path)
        now, path = step, later
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres), path
