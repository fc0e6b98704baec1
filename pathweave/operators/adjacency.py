"""Neighbour lists, degrees and integrity of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.blocks import Blocks


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_deg, in_deg), multi-edges counted; one shuffle, with partial counts."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg"))


def lists(graph: Blocks, vertexes: DataFrame | None = None) -> DataFrame:
    """(id, outgoing, incoming): whole lists, ascending and with duplicates, put together from blocks.

    A list has no bound, so this is for graphs whose lists fit a row; others are
    read by block.  Vertices without edges have empty lists.
    """
    again = F.flatten(F.zip_with("w", "times", lambda w, n: F.array_repeat(w, n.cast("int"))))
    parts = graph.rows.select(F.col("v").alias("id"), "side", F.struct("part", F.when(F.col("times").isNull(), F.col("w")).otherwise(again).alias("w")).alias("x"))
    if vertexes is not None:
        parts = parts.unionByName(vertexes.select("id", F.lit(None).cast("string").alias("side"), F.lit(None).cast(parts.schema["x"].dataType).alias("x")))
    side = lambda s: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("x")))), lambda x: x["w"]))
    return parts.groupBy("id").agg(side("f").alias("outgoing"), side("b").alias("incoming"))


def neighbors(vertex_id: int, edges: DataFrame, vertexes: DataFrame) -> DataFrame:
    """(direction, id, title) of the distinct neighbours of a vertex; ids without a page have a null title."""
    out = edges.filter(F.col("src") == vertex_id).select(F.lit("out").alias("direction"), F.col("dst").alias("id"))
    back = edges.filter(F.col("dst") == vertex_id).select(F.lit("in").alias("direction"), F.col("src").alias("id"))
    return out.unionByName(back).distinct().join(vertexes.select("id", "title"), "id", "left").select("direction", "id", "title")


def read_edges(vertex_id: int, graph: Blocks, vertexes: DataFrame) -> DataFrame:
    """As neighbors(), from stored blocks: a point read, part by part."""
    own = graph.neighbours(vertex_id).select(F.when(F.col("side") == "f", "out").otherwise("in").alias("direction"), F.explode("w").alias("id"))
    return own.join(vertexes.select("id", "title"), "id", "left").select("direction", "id", "title")


def validate(edges: DataFrame, vertexes: DataFrame) -> DataFrame:
    """(check, failures): all zero for a sound graph."""
    top = vertexes.agg(F.max("id").alias("top"), F.count("*").alias("n"), F.sum(F.when(F.col("id").isNull() | (F.col("id") <= 0), 1).otherwise(0)).alias("bad"))
    d = degrees(edges).agg(F.sum(F.col("out_deg") - F.col("in_deg")).alias("difference"))
    e = edges.agg(
        F.count("*").alias("n_edges"), F.sum(F.when(F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") <= 0) | (F.col("dst") <= 0), 1).otherwise(0)).alias("bad_edges"),
        F.max(F.greatest("src", "dst")).alias("top_end"))
    # three one-row summaries
    one = top.join(d).join(e)
    checks = {
        "no_vertexes": F.when(F.col("n") == 0, 1).otherwise(0), "bad_vertex_ids": F.coalesce("bad", F.lit(0)), "no_edges": F.when(F.col("n_edges") == 0, 1).otherwise(0),
        "bad_edge_ids": F.coalesce("bad_edges", F.lit(0)), "degree_difference": F.abs(F.coalesce("difference", F.lit(0))), "ends_beyond_max_id": F.when(F.col("top_end") > F.col("top"), 1).otherwise(0),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("bigint").alias("failures")) for k, v in checks.items()])).alias("c")).select("c.check", "c.failures")
