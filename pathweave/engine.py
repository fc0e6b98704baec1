"""Facade: build a graph from dump tables, keep it by date, and query it.

Two lifetimes: ``<base>/master`` holds the search log, ``<base>/<date>`` the
graph and the path cache, so that a new build starts with an empty cache.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave import schema
from pathweave.operators import adjacency, bfs, blocks, cache, lookup, paths, resolve, toppages
from pathweave.operators.blocks import Blocks
from pathweave.plans import manifest, storage
from pathweave.sources import sqldump, sqltuples

DUMP_FILES = ("page", "pagelinks", "redirect", "linktarget")
EDGES_A_BUCKET = 2_000_000


class GraphEngine:
    def __init__(self, spark: SparkSession, base: str, dump_date: str | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.dump_date = dump_date or manifest.current(spark, self.base) or ""
        self.folder = f"{self.base}/{self.dump_date}"

    # ------------------------------------------------------------------ build

    def dump_tables(self, folder: str, prefix: str) -> dict[str, DataFrame]:
        """Typed tables of the files <folder>/<prefix>-<date>-<table>.sql.gz."""
        return {name: sqldump.parse(self._lines(folder, prefix, name), name) for name in DUMP_FILES}

    def _lines(self, folder: str, prefix: str, name: str) -> DataFrame:
        return sqldump.read_lines(self.spark, f"{folder}/{prefix}-{self.dump_date}-{name}.sql.gz")

    def build(self, tables: dict[str, DataFrame], publish: bool = True, clean: bool = False) -> manifest.Manifest:
        """Resolve and store the graph, one stage after the other; finished stages are not done again."""
        status = manifest.load(self.spark, self.folder)
        status.dump_date = self.dump_date
        if not status.vertexes_loaded:
            status.vertex_count = self._stage(status, "vertexes", resolve.vertexes(tables["page"]))
            status.vertexes_loaded = True
            manifest.save(self.spark, self.folder, status)
        if not status.redirects_resolved:
            self._stage(status, "redirects", resolve.redirects(tables["redirect"], self.vertexes))
            status.redirects_resolved = True
            manifest.save(self.spark, self.folder, status)
        if "titles" not in status.stage_rows:
            index = lookup.titles(self.vertexes, self.read("redirects", schema.REDIRECTS))
            self._timed(status, "titles", lambda: (lookup.write_titles(index, f"{self.folder}/titles"), self.titles.count())[1])
            manifest.save(self.spark, self.folder, status)
        if not status.edges_resolved:
            status.edge_count = self._stage(status, "links", resolve.links(tables["pagelinks"], resolve.link_targets(tables["linktarget"])))
            links = self.read("links", schema.LINKS)
            status.resolved_edge_count = self._stage(status, "edges", resolve.edges(links, self.vertexes, self.read("redirects", schema.REDIRECTS)))
            status.edges_resolved = True
            manifest.save(self.spark, self.folder, status)
        if not status.edges_sorted:
            # as many buckets as a reader deals to, or more where these would be large
            status.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), status.resolved_edge_count // EDGES_A_BUCKET)
            with storage.scope(self.spark):
                self._timed(status, "blocks", lambda: blocks.build(self.edges, f"{self.folder}/blocks", status.buckets).rows.count())
            made = blocks.read(self.spark, f"{self.folder}/blocks", status.buckets)
            status.distinct_edge_count = made.rows.filter("side = 'f'").agg(F.sum(F.size(F.filter("w", lambda w: w != F.col("v"))))).first()[0] or 0
            status.edges_sorted = status.build_complete = True
            manifest.save(self.spark, self.folder, status)
        if publish:
            manifest.publish(self.spark, self.base, self.dump_date, clean)
        return status

    def _stage(self, status: manifest.Manifest, name: str, df: DataFrame) -> int:
        """Store a table and note its rows and seconds."""
        def stored() -> int:
            self._write(df, name)
            return self.read(name).count()

        return self._timed(status, name, stored)

    @staticmethod
    def _timed(status: manifest.Manifest, name: str, make: Callable[[], int]) -> int:
        began = time.time()
        status.stage_rows[name] = make()
        status.stage_seconds[name] = round(time.time() - began, 3)
        return status.stage_rows[name]

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def read(self, name: str, kind=None) -> DataFrame:
        path = f"{self.folder}/{name}"
        if kind is not None and not storage.exists(self.spark, path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.parquet(path)

    @property
    def vertexes(self) -> DataFrame:
        return self.read("vertexes")

    @property
    def titles(self) -> DataFrame:
        """Pages in the order of their titles."""
        return self.read("titles")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    @property
    def graph(self) -> Blocks:
        """What searches and point reads see: the stored blocks."""
        status = manifest.load(self.spark, self.folder)
        if "blocks" not in status.stage_rows:
            raise RuntimeError(f"{self.folder} holds no blocks: build it again")
        return blocks.read(self.spark, f"{self.folder}/blocks", status.buckets)

    @property
    def cache(self) -> cache.PathCache:
        return cache.PathCache(self.spark, f"{self.folder}/path")

    def malformed(self, folder: str, prefix: str) -> DataFrame:
        """(file, line, n, text, error): tuples of the dumps that are not loaded, with the reason."""
        found = [sqltuples.malformed(self._lines(folder, prefix, name), name).select(F.lit(name).alias("file"), "line", "n", "text", "error") for name in DUMP_FILES]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def failures(self) -> tuple[DataFrame, DataFrame]:
        """(links to titles no page has, redirect pages without a target)."""
        return resolve.unresolved_links(self.read("links"), self.vertexes), resolve.redirect_failures(self.vertexes, self.read("redirects"))

    def validate(self) -> DataFrame:
        return adjacency.validate(self.edges, self.vertexes)

    # ------------------------------------------------------------------ query

    def status(self) -> dict:
        s = manifest.load(self.spark, self.folder)
        return {"date": s.date().isoformat() if s.date() else None, "vertexCount": s.vertex_count, "edgeCount": s.edge_count}

    def shortest_paths(self, pairs: DataFrame, record: bool = True, validate: bool = False) -> DataFrame:
        """All shortest paths of pairs (source_id, target_id), from the cache where it has them."""
        with storage.scope(self.spark):
            pairs = storage.stored(pairs.select("source_id", "target_id").distinct(), "pairs")
            if validate:
                ends = pairs.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
                missing = ends.join(self.vertexes.select("id"), "id", "left_anti").limit(5).collect()
                if missing:
                    raise KeyError(f"no such pages: {[r.id for r in missing]}")
            began = time.time()
            found, new = cache.cached_paths(pairs, self.graph, self.cache.rows(pairs))
            found = storage.stored(found, "paths", keep=True)
            if record:
                seconds = time.time() - began
                self.cache.add(new.withColumn("duration", F.lit(seconds)))
                log = pairs.select(F.col("source_id").alias("source_page_id"), F.col("target_id").alias("target_page_id"), F.current_timestamp().alias("timestamp"), F.lit(int(seconds * 1000)).alias("duration").cast("bigint"))
                log.write.mode("append").parquet(f"{self.base}/master/search")
            return found

    def query(self, source_id: int, target_id: int, record: bool = True, validate: bool = False) -> dict:
        """{paths, count, degrees, duration in ms} of one pair."""
        began = time.time()
        pair = self.spark.createDataFrame([(source_id, target_id)], "source_id bigint, target_id bigint")
        with storage.scope(self.spark):
            found = sorted(r.path for r in self.shortest_paths(pair, record, validate).collect())
        return {"paths": found, "count": len(found), "degrees": max(map(len, found)) - 1 if found else None, "duration": int((time.time() - began) * 1000)}

    def paths_by_title(self, source: str, target: str) -> list[str]:
        """Titles of each shortest path; KeyError for an unknown title."""
        ends = [lookup.by_title(self.titles, t).first() for t in (source, target)]
        for title, end in zip((source, target), ends, strict=True):
            if end is None:
                raise KeyError(title)
        pair = self.spark.createDataFrame([(ends[0].id, ends[1].id)], "source_id bigint, target_id bigint")
        with storage.scope(self.spark):
            found = storage.stored(bfs.shortest_paths(pair, self.graph), "paths")
            return sorted(r.titles for r in paths.path_titles(found, self.vertexes).collect())

    def neighbors(self, title: str) -> DataFrame:
        page = lookup.by_title(self.titles, title).first()
        if page is None:
            raise KeyError(title)
        return adjacency.read_edges(page.id, self.graph, self.vertexes)

    def search(self, prefix: str, limit: int = 5) -> DataFrame:
        """(position, id, title) of pages whose title, or that of a redirect to them, begins with ``prefix``."""
        return lookup.search_prefix(self.titles, prefix, limit)

    def random_page(self, seed: int | None = None) -> dict | None:
        return lookup.random_page(self.vertexes, seed)

    def probe(self, seed: int | None = None) -> dict | None:
        """Search between two pages drawn at random, none of them a redirect; None if there are fewer than two."""
        ends = [r.id for r in lookup.random_pages(self.vertexes, 2, seed).collect()]
        return {"source": ends[0], "target": ends[1], **self.query(*ends)} if len(ends) == 2 else None

    def long_paths_report(self, least: int = 5, limit: int = 20) -> DataFrame:
        return cache.long_paths(self.cache.rows(), self.vertexes, least, limit)

    def search_log(self) -> DataFrame:
        path = f"{self.base}/master/search"
        return self.spark.read.parquet(path) if storage.exists(self.spark, path) else self.spark.createDataFrame([], schema.SEARCH_LOG)

    # -------------------------------------------------------- derived products

    def make_top_graph(self, articles: DataFrame, pages: int = 10) -> str:
        path = f"{self.folder}/topgraph.json"
        with storage.scope(self.spark):
            points, raw, _ = toppages.top_graph(toppages.ranked(articles, self.vertexes, pages), self.vertexes, self.graph)
            toppages.write_top_graph(self.spark, points, raw, path)
        return path

    def sitemap(self, articles: DataFrame, base_url: str) -> list[str]:
        with storage.scope(self.spark):
            top = storage.stored(toppages.ranked(articles, self.vertexes), "top")
            return toppages.write_sitemap(self.spark, toppages.sitemap_urls(top, base_url), f"{self.folder}/sitemaps", base_url)

    def refresh(self, tables: dict[str, DataFrame], articles: DataFrame, base_url: str, clean: bool = False) -> bool:
        """Build, sitemap and top graph, unless this date is published and complete."""
        if manifest.current(self.spark, self.base) == self.dump_date and manifest.load(self.spark, self.folder).build_complete:
            return False
        self.build(tables, publish=False)
        self.sitemap(articles, base_url)
        self.make_top_graph(articles)
        manifest.publish(self.spark, self.base, self.dump_date, clean)
        return True
