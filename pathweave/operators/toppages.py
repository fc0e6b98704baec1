"""Top pages, the graph of shortest paths between them, and the sitemap of their pairs."""

from __future__ import annotations

import gzip
import json
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators import bfs, ranking
from pathweave.operators.blocks import Blocks
from pathweave.operators.paths import path_edges
from pathweave.plans import storage

URLS_PER_FILE = 50_000
#: Pages of a block of ranks.
PAIR_BLOCK = 250
_XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def ranked(articles: DataFrame, vertexes: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, title, views, rank): listed articles that are pages, ranked anew from 1 without gaps."""
    ids = vertexes.groupBy("title").agg(F.min("id").alias("id"))
    known = articles.join(ids, "title").withColumnRenamed("rank", "listed")
    if limit is not None:
        known = known.orderBy("listed", "title", "id").limit(limit)
    return ranking.numbered(known, ["listed", "title", "id"], "rank").select("id", "title", "views", "rank")


def missing(articles: DataFrame, vertexes: DataFrame) -> DataFrame:
    """Listed articles that no page has."""
    return articles.join(vertexes.select("title"), "title", "left_anti").select("title", "views", "rank")


def pairs(top: DataFrame) -> DataFrame:
    """Ordered pairs of different top pages.

    Pages are cut into blocks of ranks, and each pair of blocks is one key of an
    equi-join: a task pairs PAIR_BLOCK pages with as many, however long the list is.
    """
    blocks = F.sequence(F.lit(0), F.lit(int((top.agg(F.max("rank")).first()[0] or 0) // PAIR_BLOCK)))
    own = F.floor(F.col("rank") / PAIR_BLOCK).cast("int")
    a = top.select(F.col("id").alias("source_id"), F.col("rank").alias("s"), own.alias("i"), F.explode(blocks).alias("j"))
    b = top.select(F.col("id").alias("target_id"), F.col("rank").alias("t"), F.explode(blocks).alias("i"), own.alias("j"))
    return a.join(b, ["i", "j"]).filter("s <> t").select("source_id", "target_id", "s", "t")


def top_graph(top: DataFrame, vertexes: DataFrame, graph: DataFrame | Blocks) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertexes, edges with duplicates, distinct edges) of all shortest paths between top pages."""
    top = storage.stored(top, "top")
    paths = storage.stored(bfs.shortest_paths(pairs(top), graph), "toppaths")
    raw = path_edges(paths)
    ids = paths.select(F.explode("path").alias("id")).distinct()
    found = ids.join(vertexes.select("id", "title"), "id").join(top.select("id", "rank"), "id", "left")
    points = found.select("id", "title", F.col("rank").isNotNull().alias("top"), "rank")
    known = points.select("id")
    distinct = raw.distinct().join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return points, raw, distinct


def write_top_graph(spark: SparkSession, points: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one JSON document; it is bounded by the paths between the top pages and meant for a browser."""
    v = [{"id": str(r.id), "title": r.title, "top": r.top, "rank": r["rank"]} for r in points.orderBy("id").toLocalIterator()]
    e = [{"source": str(r.src), "target": str(r.dst)} for r in edges.orderBy("src", "dst").toLocalIterator()]
    storage.write_bytes(spark, path, json.dumps({"vertexes": v, "edges": e}, indent=2, ensure_ascii=False).encode())


def sitemap_urls(top: DataFrame, base_url: str, per_file: int = URLS_PER_FILE) -> DataFrame:
    """(position, chunk, url): the site, then a page for each pair, numbered by the ranks of the pair without a global sort."""
    n = top.count()
    place = 1 + (F.col("s") - 1) * (n - 1) + F.col("t") - 1 - F.when(F.col("t") > F.col("s"), 1).otherwise(0)
    rows = pairs(top).select(place.cast("bigint").alias("position"), F.concat(F.lit(f"{base_url}/paths/"), F.col("source_id").cast("string"), F.lit("/"), F.col("target_id").cast("string")).alias("url"))
    root = top.sparkSession.createDataFrame([(0, base_url)], "position bigint, url string")
    return root.unionByName(rows).select("position", F.floor(F.col("position") / per_file).alias("chunk"), "url")


def _entry(url: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        url = F.replace(url, F.lit(char), F.lit(reference))
    return F.concat(F.lit("<url><loc>"), url, F.lit("</loc><changefreq>monthly</changefreq></url>"))


_HEAD, _TAIL = f'<?xml version="1.0" encoding="utf-8"?><urlset xmlns="{_XMLNS}">', "</urlset>"


def sitemap_documents(urls: DataFrame) -> DataFrame:
    """(chunk, n_urls, xml): a document for each chunk."""
    rows = urls.select("chunk", F.struct("position", _entry(F.col("url")).alias("entry")).alias("e")).groupBy("chunk").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select("chunk", F.size("e").alias("n_urls"), F.concat(F.lit(_HEAD), F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.lit(_TAIL)).alias("xml"))


def write_sitemap(spark: SparkSession, urls: DataFrame, folder: str, base_url: str) -> list[str]:
    """sitemap-<chunk>.xml.gz and sitemap-index.xml.gz.

    Tasks write the chunks, each as the lines of one gzipped text file, beside
    their place and under Spark's commit of tasks, so that a task that is tried
    again leaves one file.  The driver renames what was committed.
    """
    lines = urls.select("chunk", "position", _entry(F.col("url")).alias("line"))
    ends = urls.groupBy("chunk").agg(F.min("position").alias("first"), F.max("position").alias("last")).select(
        "chunk", F.explode(F.array(F.struct((F.col("first") - 1).alias("position"), F.lit(_HEAD).alias("line")), F.struct((F.col("last") + 1).alias("position"), F.lit(_TAIL).alias("line")))).alias("e")).select("chunk", "e.*")
    beside = f"{folder}/chunks.tmp"
    lines.unionByName(ends).repartition("chunk").sortWithinPartitions("chunk", "position").select("chunk", "line").write.mode("overwrite").partitionBy("chunk").option("compression", "gzip").text(beside)
    chunks = sorted(int(name.split("=")[1]) for name in storage.children(spark, beside) if name.startswith("chunk="))
    names = []
    for chunk in chunks:
        [part] = [name for name in storage.children(spark, f"{beside}/chunk={chunk}") if name.startswith("part-")]
        names.append(f"sitemap-{chunk}.xml.gz")
        storage.replace(spark, f"{beside}/chunk={chunk}/{part}", f"{folder}/{names[-1]}")
    storage.delete(spark, beside)
    entries = "".join(f"<sitemap><loc>{escape(base_url)}/sitemaps/{name}</loc></sitemap>" for name in names)
    index = f'<?xml version="1.0" encoding="utf-8"?><sitemapindex xmlns="{_XMLNS}">{entries}</sitemapindex>'
    storage.write_bytes(spark, f"{folder}/sitemap-index.xml.gz", gzip.compress(index.encode()))
    return [*names, "sitemap-index.xml.gz"]
