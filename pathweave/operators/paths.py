"""What is made of paths: summaries, titles, edges, layout, item lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions import path_pairs, url_title

#: Drawing area of a path graph (fixed values).
SPACE, MARGIN, PADDING = 8192, 50, 400


def path_summary(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_id, target_id, count, degrees): degrees are edges of a path, null without one."""
    found = paths.groupBy("source_id", "target_id").agg(F.count("*").alias("count"), (F.max(F.size("path")) - 1).alias("degrees"))
    return pairs.select("source_id", "target_id").distinct().join(found, ["source_id", "target_id"], "left").select(
        "source_id", "target_id", F.coalesce("count", F.lit(0)).alias("count"), "degrees")


def path_positions(paths: DataFrame) -> DataFrame:
    """One row for each vertex of each path: (source_id, target_id, path, position, id), positions from 1."""
    return paths.select("source_id", "target_id", "path", F.posexplode("path").alias("at", "id")).withColumn("position", F.col("at") + 1).drop("at")


def path_titles(paths: DataFrame, vertexes: DataFrame, sep: str = " → ") -> DataFrame:
    """(source_id, target_id, path, titles): titles joined in the path's order; ids without a page are left out."""
    titled = path_positions(paths).join(vertexes.select("id", "title"), "id")
    return titled.groupBy("source_id", "target_id", "path").agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("t")).select(
        "source_id", "target_id", "path", F.array_join(F.transform("t", lambda x: x["title"]), sep).alias("titles"))


def path_edges(paths: DataFrame) -> DataFrame:
    """(src, dst) of every step of every path, with duplicates."""
    return paths.select(F.explode(path_pairs(F.col("path"))).alias("e")).select("e.src", "e.dst")


def path_layout(paths: DataFrame) -> DataFrame:
    """(source_id, target_id, id, rank, x, y): x by least depth, y by the mean number of the paths through a vertex.

    Paths of a pair are numbered in lexicographic order.
    """
    pair = Window.partitionBy("source_id", "target_id")
    numbered = paths.withColumn("path_ix", F.row_number().over(pair.orderBy("path")) - 1).withColumn("n_paths", F.count("*").over(pair)).withColumn("max_depth", F.max(F.size("path") - 1).over(pair))
    spots = numbered.select("source_id", "target_id", "path_ix", "n_paths", "max_depth", F.posexplode("path").alias("depth", "id"))
    per = spots.groupBy("source_id", "target_id", "id").agg(
        F.min("depth").alias("depth"), F.avg("path_ix").alias("mean_ix"), F.max("n_paths").alias("n_paths"), F.max("max_depth").alias("max_depth"))
    source, target = F.col("id") == F.col("source_id"), F.col("id") == F.col("target_id")
    x = F.when(source, F.lit(float(MARGIN))).when(target, F.lit(float(SPACE - MARGIN))).otherwise(
        MARGIN + F.col("depth") / F.greatest(F.lit(1), F.col("max_depth")) * (SPACE - 2 * MARGIN))
    y = PADDING + F.col("mean_ix") / F.greatest(F.lit(1), F.col("n_paths") - 1) * (SPACE - 2 * PADDING)
    return per.select("source_id", "target_id", "id", F.when(source, 2).when(target, 1).otherwise(0).alias("rank"), x.alias("x"), y.alias("y"))


def first_paths(paths: DataFrame) -> DataFrame:
    """The first path of each pair in lexicographic order."""
    return paths.groupBy("source_id", "target_id").agg(F.min("path").alias("path"))


def item_list(paths: DataFrame, vertexes: DataFrame, page_url: str) -> DataFrame:
    """(source_id, target_id, position, item): JSON list items of the first path's pages."""
    pages = path_positions(first_paths(paths)).join(vertexes.select("id", "title"), "id")
    item = F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("position"), F.col("title").alias("name"), F.concat(F.lit(page_url), url_title(F.col("title"))).alias("url")))
    return pages.select("source_id", "target_id", "position", item.alias("item"))


def enrich(paths: DataFrame, vertexes: DataFrame, page_meta: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, position, id, title, description) of the distinct pages of each pair's paths.

    ``page_meta`` (id, shortdesc, terms array) is optional; a term's description goes before the short one.
    """
    pages = path_positions(paths).select("source_id", "target_id", "position", "id").distinct().join(vertexes.select("id", "title"), "id", "left")
    if page_meta is None:
        return pages.withColumn("description", F.lit(None).cast("string"))
    meta = page_meta.select("id", F.coalesce(F.get("terms", F.lit(0)), "shortdesc").alias("description"))
    return pages.join(meta, "id", "left")
