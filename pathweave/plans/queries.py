"""Named queries over the test tables, and DuckDB SQL that must give the same rows.

Two graphs: G0 links customers of consecutive orders directly; G1 goes through
dump-shaped tables with namespaces, missing titles and redirects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import numbered_title, path_text
from pathweave.operators import adjacency, bfs, blocks, cache, lookup, paths, resolve, toppages
from pathweave.plans import storage
from pathweave.plans.storage import stored
from pathweave.sources import jsonapi, sqldump, sqltuples, tables, weblinks

G0_PAIRS = [(2, 3), (2, 100), (8, 50), (8, 8), (101, 140), (2, 20), (60, 7), (2, 800)]
BASE_URL = "https://links.example"
PAGE_URL = "https://pages.example/"


def _pairs(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, "source_id bigint, target_id bigint")


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return resolve.resolve(tables.dump_tables(spark, sf_dir))


def _g1(name: str):
    return lambda spark, sf_dir: _graph(spark, sf_dir)[name]


def _shown(found: DataFrame) -> DataFrame:
    return found.select("source_id", "target_id", path_text(F.col("path")).alias("path"), (F.size("path") - 1).alias("degrees"))


def _kept(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; the scratch tables that it took are removed."""
    with storage.scope(spark):
        return stored(make(), "result", keep=True)


def _raw(pairs: list[tuple[int, int]], urgent: bool = False):
    return lambda spark, sf_dir: _shown(_kept(spark, lambda: bfs.shortest_paths(_pairs(spark, pairs), tables.raw_edges(spark, sf_dir, urgent))))


def _g1_paths(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]] = G0_PAIRS) -> tuple[DataFrame, dict[str, DataFrame]]:
    g = _graph(spark, sf_dir)
    return _kept(spark, lambda: bfs.shortest_paths(_pairs(spark, pairs), g["edges"])), g


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shortest path between two pages."""
    return _raw([(2, 3)])(spark, sf_dir)


def multi_pair_levels(spark, sf_dir):
    """The pairs of multi_pair_paths in a graph of short blocks, so that vertices have several."""
    return _shown(_kept(spark, lambda: bfs.shortest_paths(_pairs(spark, G0_PAIRS), blocks.build(_graph(spark, sf_dir)["edges"], block=4))))


def multi_pair_paths(spark, sf_dir):
    return _shown(_g1_paths(spark, sf_dir)[0])


def path_summary(spark, sf_dir):
    pairs = [*G0_PAIRS, (2, 1_000_000)]
    return paths.path_summary(_pairs(spark, pairs), _g1_paths(spark, sf_dir, pairs)[0])


def path_counts(spark, sf_dir):
    found = _kept(spark, lambda: bfs.count_paths(_pairs(spark, G0_PAIRS), tables.raw_edges(spark, sf_dir)))
    return found.select("source_id", "target_id", "degrees", F.col("n_paths").cast("bigint").alias("n_paths"))


def path_titles(spark, sf_dir):
    found, g = _g1_paths(spark, sf_dir)
    return paths.path_titles(found, g["vertexes"], " > ").select("source_id", "target_id", path_text(F.col("path")).alias("path"), "titles")


def path_edges_raw(spark, sf_dir):
    return paths.path_edges(_g1_paths(spark, sf_dir)[0])


def path_edges_distinct(spark, sf_dir):
    return paths.path_edges(_g1_paths(spark, sf_dir)[0]).distinct()


def path_layout(spark, sf_dir):
    return paths.path_layout(_g1_paths(spark, sf_dir)[0]).withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4))


def item_list_jsonld(spark, sf_dir):
    found, g = _g1_paths(spark, sf_dir)
    return paths.item_list(found, g["vertexes"], PAGE_URL)


def enriched_paths(spark, sf_dir):
    found, g = _g1_paths(spark, sf_dir)
    meta = tables.read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("id"), F.col("c_mktsegment").alias("shortdesc"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_name"))).alias("terms"))
    return paths.enrich(found, g["vertexes"], meta)


def sqldump_roundtrip(spark, sf_dir):
    pages = tables.page(spark, sf_dir).withColumn("page_title", F.concat("page_title", F.lit("_it's (\\a),"), F.lit('"b"')))
    return sqldump.parse(sqldump.render(pages, "page"), "page").select("page_id", "page_namespace", "page_title", "page_is_redirect")


def dump_resolution(spark, sf_dir):
    """Edges of G1 when all four tables go through dump text."""
    parsed = {name: sqltuples.parse(sqldump.render(df, name), name) for name, df in tables.dump_tables(spark, sf_dir).items()}
    return resolve.resolve(parsed)["edges"]


def dump_rejects(spark, sf_dir):
    """Tuples of a dump of which some are broken, by what is wrong of them."""
    place, first, title = F.col("lt_id") % 20, F.concat_ws(",", F.col("lt_id").cast("string"), F.col("lt_namespace").cast("string")), F.concat(F.lit("'"), "lt_title", F.lit("'"))
    inside = F.when(place == 3, first).when(place == 9, F.concat(first, F.lit(",(1),"), title)).when(place == 14, F.concat(F.col("lt_id").cast("string"), F.lit(",,"), title)).otherwise(F.concat(first, F.lit(","), title))
    rows = tables.linktarget(spark, sf_dir).select((F.col("lt_id") % 50).alias("g"), F.concat(F.lit("("), inside, F.lit(")")).alias("t"))
    lines = rows.groupBy("g").agg(F.concat(F.lit("INSERT INTO `linktarget` VALUES "), F.array_join(F.collect_list("t"), ","), F.lit(";")).alias("value"))
    return sqltuples.tuples(lines, "linktarget").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def db_status_counts(spark, sf_dir):
    g = _graph(spark, sf_dir)
    names = ["vertexes", "link_targets", "redirects", "links", "edges", "unresolved_links", "redirect_failures"]
    counts = [g[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("metric"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def adjacency_lists(spark, sf_dir):
    g = _graph(spark, sf_dir)
    lists = _kept(spark, lambda: adjacency.lists(blocks.build(g["edges"], block=16), g["vertexes"]))
    return lists.select("id", path_text(F.col("outgoing"), ",").alias("outgoing"), path_text(F.col("incoming"), ",").alias("incoming"))


def frontier_cost(spark, sf_dir):
    edges = tables.raw_edges(spark, sf_dir)
    frontier = spark.createDataFrame([(1, "f", 2), (1, "f", 101), (1, "b", 3), (2, "f", 8), (2, "b", 50), (2, "b", 999_999)], "pair_id bigint, side string, v bigint")
    return bfs.frontier_cost(frontier, adjacency.degrees(edges))


def neighbors_titles(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return adjacency.neighbors(2, g["edges"], g["vertexes"]).select("direction", "id", "title", numbered_title(F.col("id"), F.col("title")).alias("line"))


def prefix_search(spark, sf_dir):
    return lookup.by_prefix(_graph(spark, sf_dir)["vertexes"], "Customer_00000012")


def prefix_search_redirects(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return lookup.search_prefix(lookup.titles(g["vertexes"], g["redirects"]), "Customer_00000012")


def _vertexes(find):
    return lambda spark, sf_dir: find(_graph(spark, sf_dir)["vertexes"])


def _cached(spark, sf_dir):
    """A cache of three pairs of G0: found, without path, and one that was written twice."""
    rows = [(2, 3, "2024-05-01 00:00:00", "[[9,9]]"), (2, 3, "2024-05-02 00:00:00", "[[2,952,1402,3]]"), (7, 7, "2024-05-01 00:00:00", "[[7]]"), (9, 10, "2024-05-01 00:00:00", "[]"),
            (101, 140, "2024-05-01 00:00:00", "[[101,57,734,598,140],[101,2,3,4,140]]")]
    return spark.createDataFrame(rows, "source_page_id bigint, target_page_id bigint, t string, path_data string").select(
        "source_page_id", "target_page_id", F.to_timestamp("t").alias("timestamp"), F.lit(0.5).alias("duration"), "path_data")


def _cache_of_orders(spark, sf_dir):
    """A stored cache: an order is a search of its customer, for none to two paths; it is written in ten turns, so that buckets are rewritten."""
    s, t, n = F.col("o_custkey") + 1, F.col("o_orderkey") % 7 + 1, F.col("o_orderkey") % 3
    rows = tables.read(spark, sf_dir, "orders").select(
        "o_orderkey", s.alias("source_page_id"), t.alias("target_page_id"), F.col("o_orderdate").alias("timestamp"), F.lit(0.5).alias("duration"),
        F.to_json(F.slice(F.array(F.array(s, t), F.array(s, F.lit(0).cast("bigint"), t)), F.lit(1), n.cast("int"))).alias("path_data"))
    made = cache.PathCache(spark, storage.new_path(spark, "orders"), buckets=4)
    for turn in range(10):
        made.add(rows.filter(F.col("o_orderkey") % 10 == turn))
    return made


def cache_hit_miss(spark, sf_dir):
    """The pairs of all customers against the cache."""
    pairs = tables.read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("source_id"), (F.col("c_custkey") % 7 + 1).alias("target_id"))
    return _kept(spark, lambda: _hits_and_misses(pairs, _cache_of_orders(spark, sf_dir).rows(pairs)))


def _hits_and_misses(pairs, c):
    hit = cache.hits(pairs, c).select("source_id", "target_id", F.lit("hit").alias("state"), F.size("paths").alias("n_paths"))
    return hit.unionByName(cache.misses(pairs, c).select("source_id", "target_id", F.lit("miss").alias("state"), F.lit(None).cast("int").alias("n_paths")))


def cached_search(spark, sf_dir):
    """Pairs of G0 from the cache where it has them, searched for where it has not."""
    pairs = _pairs(spark, [(7, 7), (9, 10), (101, 140), (60, 7), (2, 20)])
    return _shown(_kept(spark, lambda: cache.cached_paths(pairs, tables.raw_edges(spark, sf_dir), _cached(spark, sf_dir))[0]))


def long_paths_report(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = _kept(spark, lambda: bfs.shortest_paths(_pairs(spark, G0_PAIRS), g["edges"]))
    return cache.long_paths(cache.cache_rows(_pairs(spark, G0_PAIRS), found), g["vertexes"], least=4)


def search_log_stats(spark, sf_dir):
    return cache.search_log_stats(tables.search_log(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 4))


def _articles(spark, sf_dir):
    return jsonapi.top_pages(tables.top_pages_document(spark, sf_dir))


def top_pages_ranked(spark, sf_dir):
    return _kept(spark, lambda: toppages.ranked(_articles(spark, sf_dir), _graph(spark, sf_dir)["vertexes"]))


def missing_top_pages(spark, sf_dir):
    return toppages.missing(_articles(spark, sf_dir), _graph(spark, sf_dir)["vertexes"])


def _top_graph(part: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _graph(spark, sf_dir)
        return _kept(spark, lambda: toppages.top_graph(toppages.ranked(_articles(spark, sf_dir), g["vertexes"], 10), g["vertexes"], g["edges"])[part])

    return query


def _sitemap(spark, sf_dir):
    return toppages.sitemap_urls(top_pages_ranked(spark, sf_dir), BASE_URL)


def sitemap_urls(spark, sf_dir):
    return _sitemap(spark, sf_dir)


def sitemap_chunks(spark, sf_dir):
    return toppages.sitemap_documents(_sitemap(spark, sf_dir)).select("chunk", "n_urls", F.length("xml").cast("bigint").alias("n_chars"))


def _dump_documents(spark, sf_dir):
    """A dump status for each day of events: the last event of every fifth is the state of a job."""
    names = {"redirecttable": "redirect", "pagetable": "page", "pagepropstable": "page_props", "pagelinkstable": "pagelinks", "linktargettable": "linktarget"}
    events = tables.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("event_id") % 5).alias("job"), "event_id", "ts", "event_type", "user_id")
    last = events.groupBy("day", "job").agg(F.max_by(F.struct("ts", "event_type", "user_id"), "event_id").alias("e")).select("day", "job", "e.*")
    date = F.date_format(F.when(F.col("user_id") % 17 == 0, F.date_add("day", 1)).otherwise(F.col("day")), "yyyyMMdd")
    name = F.get(F.array(*[F.lit(n) for n in names.values()]), F.col("job").cast("int"))
    path = F.concat(F.lit("x-"), date, F.lit("-"), name, F.lit(".sql.gz"))
    file = F.struct(F.lit(1).alias("size"), F.concat(F.lit("/x/"), date, F.lit("/"), path).alias("url"))
    state = F.struct(F.when(F.col("event_type") == "error", "waiting").otherwise("done").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.create_map(path, file).alias("files"))
    jobs = last.groupBy("day").agg(*[F.max(F.when(F.col("job") == i, F.to_json(state))).alias(job) for i, job in enumerate(names)])
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{job}":'), F.col(job)) for job in names])
    return jobs.select(F.concat(F.lit('{"version":"0.8","jobs":{'), body, F.lit("}}")).alias("value"))


def dump_catalog(spark, sf_dir):
    return jsonapi.dump_catalog(_dump_documents(spark, sf_dir)).select("complete", F.date_format("dump_date", "yyyy-MM-dd").alias("dump_date"), "n_dates", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def dump_catalog_latest(spark, sf_dir):
    return jsonapi.latest_dump(jsonapi.dump_catalog(_dump_documents(spark, sf_dir))).select("version", F.date_format("dump_date", "yyyy-MM-dd").alias("dump_date"))


def graph_validate(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return adjacency.validate(g["edges"], g["vertexes"])


def html_link_extract(spark, sf_dir):
    return weblinks.page_links(tables.read(spark, sf_dir, "pages"))


QUERIES = {
    "vertexes_load": _g1("vertexes"), "link_targets_load": _g1("link_targets"), "redirect_map": _g1("redirects"), "direct_links": _g1("links"), "edges_resolved": _g1("edges"),
    "unresolved_links": _g1("unresolved_links"), "redirect_failures": _g1("redirect_failures"), "sqldump_roundtrip": sqldump_roundtrip, "dump_resolution": dump_resolution, "dump_rejects": dump_rejects,
    "max_vertex_id": _vertexes(lookup.max_id), "db_status_counts": db_status_counts, "adjacency_lists": adjacency_lists,
    "degrees": lambda spark, sf_dir: adjacency.degrees(_graph(spark, sf_dir)["edges"]), "neighbors_titles": neighbors_titles,
    "vertex_by_title": _vertexes(lambda v: lookup.by_title(v, "Customer_000000042")), "vertex_by_id": _vertexes(lambda v: lookup.by_id(v, 42)), "prefix_search": prefix_search, "prefix_search_redirects": prefix_search_redirects,
    "random_page_ge": _vertexes(lambda v: lookup.next_page(v, 77)), "sssp_single_path": _raw([(2, 3)]), "sssp_multi_path": _raw([(101, 140)]), "sssp_same": _raw([(8, 8)]),
    "sssp_unreachable": _raw([(2, 100)], urgent=True), "sssp_sparse_deep": _raw([(2, 3)], urgent=True), "multi_pair_paths": multi_pair_paths, "multi_pair_levels": multi_pair_levels, "path_summary": path_summary, "path_counts": path_counts,
    "path_titles": path_titles, "path_edges_raw": path_edges_raw, "path_edges_distinct": path_edges_distinct, "frontier_cost": frontier_cost, "path_layout": path_layout,
    "cache_hit_miss": cache_hit_miss, "cached_search": cached_search, "long_paths_report": long_paths_report, "top_pages_ranked": top_pages_ranked, "missing_top_pages": missing_top_pages,
    "top_graph_vertexes": _top_graph(0), "top_graph_edges": _top_graph(2), "sitemap_urls": sitemap_urls, "sitemap_chunks": sitemap_chunks, "dump_catalog": dump_catalog,
    "dump_catalog_latest": dump_catalog_latest, "search_log_stats": search_log_stats, "graph_validate": graph_validate, "item_list_jsonld": item_list_jsonld, "enriched_paths": enriched_paths,
    "html_link_extract": html_link_extract,
}
