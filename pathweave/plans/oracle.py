"""DuckDB SQL for the named queries: written from the definitions, not from the plans."""

from __future__ import annotations

_G0 = "edges AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey + 1 AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) + 1 AS dst, o_orderpriority AS p FROM orders) WHERE dst IS NOT NULL{urgent})"
_URGENT = " AND p LIKE '1%'"
_G1 = """page AS (SELECT c_custkey + 1 AS page_id, CASE WHEN c_nationkey = 24 THEN 1 ELSE 0 END AS page_namespace, replace(c_name, '#', '_') AS page_title, c_acctbal < 0 AS page_is_redirect FROM customer),
linktarget AS (SELECT page_id + 1000000 AS lt_id, page_namespace AS lt_namespace, page_title AS lt_title FROM page
  UNION ALL SELECT DISTINCT 2000001 + o_orderkey % 10, 0, concat('Missing_page_', CAST(o_orderkey % 10 AS VARCHAR)) FROM orders WHERE o_orderkey % 97 = 0),
pagelinks AS (SELECT p.page_id AS pl_from, p.page_namespace AS pl_from_namespace, CASE WHEN o.o_orderkey % 97 = 0 THEN 2000001 + o.o_orderkey % 10 ELSE o.nxt + 1000001 END AS pl_target_id
  FROM (SELECT o_orderkey, o_custkey, lead(o_custkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders) o JOIN page p ON p.page_id = o.o_custkey + 1 WHERE o.nxt IS NOT NULL),
redirect AS (SELECT p.page_id AS rd_from, t.page_namespace AS rd_namespace, t.page_title AS rd_title
  FROM page p CROSS JOIN (SELECT count(*) AS n FROM customer) k JOIN page t ON t.page_id = ((p.page_id - 1) * 7 + 3) % k.n + 1 WHERE p.page_is_redirect AND p.page_id % 5 <> 0),
vertexes AS (SELECT page_id AS id, replace(page_title, '_', ' ') AS title, page_is_redirect AS is_redirect FROM page WHERE page_namespace = 0),
link_targets AS (SELECT lt_id AS id, replace(lt_title, '_', ' ') AS title FROM linktarget WHERE lt_namespace = 0),
redirects AS (SELECT r.rd_from AS from_id, v.id AS to_id FROM redirect r JOIN vertexes v ON v.title = replace(r.rd_title, '_', ' ') WHERE r.rd_namespace = 0),
links AS (SELECT p.pl_from AS src, t.title AS dest_title FROM pagelinks p JOIN link_targets t ON t.id = p.pl_target_id WHERE p.pl_from_namespace = 0),
edges AS (SELECT l.src, CASE WHEN v.is_redirect THEN r.to_id ELSE v.id END AS dst FROM links l JOIN vertexes v ON v.title = l.dest_title
  LEFT JOIN redirects r ON v.is_redirect AND r.from_id = v.id WHERE NOT v.is_redirect OR r.to_id IS NOT NULL),
unresolved_links AS (SELECT l.* FROM links l ANTI JOIN vertexes v ON v.title = l.dest_title),
redirect_failures AS (SELECT v.* FROM vertexes v ANTI JOIN redirects r ON r.from_id = v.id WHERE v.is_redirect)"""
_WALK = """e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), pr(s, t) AS (VALUES {pairs}),
r AS (SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS t, CAST(s AS BIGINT) AS v, [CAST(s AS BIGINT)] AS p, 0 AS lvl FROM pr
  UNION ALL SELECT r.s, r.t, e.dst, list_append(r.p, e.dst), lvl + 1 FROM r JOIN e ON r.v = e.src WHERE lvl < {cap} AND r.v <> r.t AND NOT list_contains(r.p, e.dst)),
found AS (SELECT s, t, p, lvl FROM (SELECT *, min(lvl) OVER (PARTITION BY s, t) AS m FROM r WHERE v = t) WHERE lvl = m)"""
_TOP = """views AS (SELECT o_custkey, count(*) AS views FROM orders GROUP BY o_custkey),
articles AS (SELECT replace(c_name, '#', ' ') AS title, views, CAST(row_number() OVER (ORDER BY views DESC, o_custkey) AS INTEGER) AS rank FROM views JOIN customer ON c_custkey = o_custkey ORDER BY rank LIMIT 1000),
ranked AS (SELECT id, title, views, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM articles JOIN vertexes USING (title))"""
#: Distances from and to the ten top pages give every vertex and edge of a shortest path between two of them.
_TOP_GRAPH = """top AS (SELECT id, rank FROM ranked WHERE rank <= 10), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
f AS (SELECT id AS s, id AS v, 0 AS lvl FROM top UNION SELECT f.s, e.dst, lvl + 1 FROM f JOIN e ON f.v = e.src WHERE lvl < 8),
b AS (SELECT id AS t, id AS v, 0 AS lvl FROM top UNION SELECT b.t, e.src, lvl + 1 FROM b JOIN e ON b.v = e.dst WHERE lvl < 8),
ds AS (SELECT s, v, min(lvl) AS d FROM f GROUP BY ALL), dt AS (SELECT t, v, min(lvl) AS d FROM b GROUP BY ALL),
dist AS (SELECT s, v AS t, d FROM ds WHERE v IN (SELECT id FROM top) AND v <> s)"""
PAIRS = "(2,3),(2,100),(8,50),(8,8),(101,140),(2,20),(60,7),(2,800)"


def _g0(body: str, urgent: bool = False) -> str:
    return f"WITH RECURSIVE {_G0.format(urgent=_URGENT if urgent else '')}, {body}"


def _g1(body: str) -> str:
    return f"WITH RECURSIVE {_G1} {body}"


def _walk(pairs: str, cap: int) -> str:
    return _WALK.format(pairs=pairs, cap=cap)


_SHOWN = " SELECT s AS source_id, t AS target_id, array_to_string(p, '>') AS path, lvl AS degrees FROM found"
_STEPS = ", steps AS (SELECT p[i] AS src, p[i + 1] AS dst FROM (SELECT p, unnest(range(1, len(p))) AS i FROM found))"
_SPOTS = ", spots AS (SELECT s, t, p, unnest(range(1, len(p) + 1)) AS position, unnest(p) AS id FROM found)"
_CATALOG = """WITH last AS (SELECT CAST(ts AS DATE) AS day, event_id % 5 AS job, arg_max(ts, event_id) AS changed, arg_max(event_type, event_id) AS kind, arg_max(user_id, event_id) AS who FROM events GROUP BY ALL),
dated AS (SELECT *, CASE WHEN who % 17 = 0 THEN day + 1 ELSE day END AS d FROM last),
catalog AS (SELECT count(*) = 5 AND bool_and(kind <> 'error') AS complete, CASE WHEN count(DISTINCT d) = 1 THEN strftime(min(d), '%Y-%m-%d') END AS dump_date, CAST(count(DISTINCT d) AS INTEGER) AS n_dates,
  strftime(date_trunc('second', max(changed)), '%Y-%m-%d %H:%M:%S') AS updated FROM dated GROUP BY day)"""
_SITEMAP = _g1(f""", {_TOP}, top AS (SELECT id, rank FROM ranked),
p AS (SELECT 'https://links.example/paths/' || a.id || '/' || b.id AS url, row_number() OVER (ORDER BY a.rank, b.rank) AS position FROM top a JOIN top b ON a.rank <> b.rank),
u AS (SELECT 0 AS position, 'https://links.example' AS url UNION ALL SELECT position, url FROM p), w AS (SELECT CAST(position AS BIGINT) AS position, CAST(position // 50000 AS BIGINT) AS chunk, url FROM u)""")
_EMPTY_XML = len('<?xml version="1.0" encoding="utf-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>')
_URL_XML = len("<url><loc></loc><changefreq>monthly</changefreq></url>")

ORACLE = {
    "vertexes_load": _g1("SELECT * FROM vertexes"), "link_targets_load": _g1("SELECT * FROM link_targets"), "redirect_map": _g1("SELECT * FROM redirects"),
    "direct_links": _g1("SELECT * FROM links"), "edges_resolved": _g1("SELECT * FROM edges"), "dump_resolution": _g1("SELECT * FROM edges"),
    "unresolved_links": _g1("SELECT * FROM unresolved_links"), "redirect_failures": _g1("SELECT * FROM redirect_failures"),
    "sqldump_roundtrip": _g1("""SELECT page_id, page_namespace, concat(page_title, '_it''s (\\a),"b"') AS page_title, page_is_redirect FROM page""").replace("\\\\", "\\"),
    "dump_rejects": _g1("SELECT CASE lt_id % 20 WHEN 3 THEN '2 values where 3 are due' WHEN 9 THEN 'parenthesis inside a tuple' WHEN 14 THEN 'values not understood' ELSE 'none' END AS error, count(*) AS n FROM linktarget GROUP BY 1"),
    "max_vertex_id": _g1("SELECT max(id) AS max_id FROM vertexes"),
    "db_status_counts": _g1(" UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS n FROM {n}" for n in ("vertexes", "link_targets", "redirects", "links", "edges", "unresolved_links", "redirect_failures"))),
    "adjacency_lists": _g1(""", ids AS (SELECT id FROM vertexes UNION SELECT src FROM edges UNION SELECT dst FROM edges),
o AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS x FROM edges GROUP BY src), i AS (SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS x FROM edges GROUP BY dst)
SELECT ids.id, coalesce(o.x, '') AS outgoing, coalesce(i.x, '') AS incoming FROM ids LEFT JOIN o ON o.id = ids.id LEFT JOIN i ON i.id = ids.id"""),
    "degrees": _g1(", x AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT id, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(i) AS BIGINT) AS in_deg FROM x GROUP BY id"),
    "neighbors_titles": _g1(""", n AS (SELECT 'out' AS direction, dst AS id FROM edges WHERE src = 2 UNION SELECT 'in', src FROM edges WHERE dst = 2)
SELECT direction, n.id, title, lpad(CAST(n.id AS VARCHAR), 9, '0') || chr(9) || coalesce(title, 'null') AS line FROM n LEFT JOIN vertexes v ON v.id = n.id"""),
    "vertex_by_title": _g1("SELECT * FROM vertexes WHERE title = 'Customer 000000042'"), "vertex_by_id": _g1("SELECT * FROM vertexes WHERE id = 42"),
    "prefix_search": _g1("SELECT * FROM vertexes WHERE starts_with(title, 'Customer 00000012') ORDER BY title, id LIMIT 5"),
    "prefix_search_redirects": _g1(""", t AS (SELECT v.title, v.id, coalesce(u.id, v.id) AS page, coalesce(u.title, v.title) AS page_title FROM vertexes v
  LEFT JOIN redirects r ON v.is_redirect AND r.from_id = v.id LEFT JOIN vertexes u ON u.id = r.to_id),
h AS (SELECT *, row_number() OVER (ORDER BY title, id) AS k FROM t WHERE starts_with(title, 'Customer 00000012'))
SELECT CAST(min(k) AS INTEGER) AS position, page AS id, page_title AS title FROM h WHERE k <= 5 GROUP BY ALL"""),
    "random_page_ge": _g1("SELECT * FROM vertexes WHERE id >= 77 AND NOT is_redirect ORDER BY id LIMIT 1"),
    "sssp_single_path": _g0(_walk("(2,3)", 4) + _SHOWN), "sssp_multi_path": _g0(_walk("(101,140)", 4) + _SHOWN), "sssp_same": _g0(_walk("(8,8)", 1) + _SHOWN),
    "sssp_unreachable": _g0(_walk("(2,100)", 8) + _SHOWN, True), "sssp_sparse_deep": _g0(_walk("(2,3)", 10) + _SHOWN, True),
    "multi_pair_paths": _g1(", " + _walk(PAIRS, 4) + _SHOWN),
    "multi_pair_levels": _g1(", " + _walk(PAIRS, 4) + _SHOWN),
    "path_summary": _g1(f", {_walk(PAIRS + ',(2,1000000)', 4)}, n AS (SELECT s, t, count(*) AS count, max(lvl) AS degrees FROM found GROUP BY ALL) SELECT CAST(pr.s AS BIGINT) AS source_id, CAST(pr.t AS BIGINT) AS target_id, coalesce(count, 0) AS count, degrees FROM pr LEFT JOIN n ON n.s = pr.s AND n.t = pr.t"),
    "path_counts": _g0(_walk(PAIRS, 4) + " SELECT s AS source_id, t AS target_id, lvl AS degrees, count(*) AS n_paths FROM found GROUP BY ALL"),
    "path_titles": _g1(f", {_walk(PAIRS, 4)}{_SPOTS} SELECT s AS source_id, t AS target_id, array_to_string(p, '>') AS path, string_agg(title, ' > ' ORDER BY position) AS titles FROM spots JOIN vertexes USING (id) GROUP BY s, t, p"),
    "path_edges_raw": _g1(f", {_walk(PAIRS, 4)}{_STEPS} SELECT * FROM steps"), "path_edges_distinct": _g1(f", {_walk(PAIRS, 4)}{_STEPS} SELECT DISTINCT * FROM steps"),
    "frontier_cost": _g0("""q(pair_id, side, v) AS (VALUES (1, 'f', 2), (1, 'f', 101), (1, 'b', 3), (2, 'f', 8), (2, 'b', 50), (2, 'b', 999999))
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(sum(CASE WHEN side = 'f' THEN (SELECT count(*) FROM edges WHERE src = v) ELSE 0 END) AS BIGINT) AS f_cost,
  CAST(sum(CASE WHEN side = 'b' THEN (SELECT count(*) FROM edges WHERE dst = v) ELSE 0 END) AS BIGINT) AS b_cost FROM q GROUP BY pair_id"""),
    "path_layout": _g1(f""", {_walk(PAIRS, 4)}, numbered AS (SELECT s, t, p, row_number() OVER (PARTITION BY s, t ORDER BY p) - 1 AS ix, count(*) OVER (PARTITION BY s, t) AS n, lvl AS deep FROM found),
spots AS (SELECT s, t, ix, n, deep, unnest(range(0, len(p))) AS depth, unnest(p) AS id FROM numbered),
per AS (SELECT s, t, id, min(depth) AS depth, avg(ix) AS ix, max(n) AS n, max(deep) AS deep FROM spots GROUP BY s, t, id)
SELECT s AS source_id, t AS target_id, id, CASE WHEN id = s THEN 2 WHEN id = t THEN 1 ELSE 0 END AS rank,
  round(CASE WHEN id = s THEN 50.0::DOUBLE WHEN id = t THEN 8142.0::DOUBLE ELSE 50 + depth::DOUBLE / greatest(1, deep) * 8092 END, 4) AS x, round(400 + ix / greatest(1, n - 1) * 7392, 4) AS y FROM per"""),
    "cache_hit_miss": """WITH c AS (SELECT o_custkey + 1 AS s, o_orderkey % 7 + 1 AS t, o_orderdate AS found, CAST(o_orderkey % 3 AS INTEGER) AS n FROM orders),
l AS (SELECT s, t, n, row_number() OVER (PARTITION BY s, t ORDER BY found DESC, CASE n WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END) AS k FROM c),
q AS (SELECT c_custkey + 1 AS s, c_custkey % 7 + 1 AS t FROM customer)
SELECT q.s AS source_id, q.t AS target_id, CASE WHEN n IS NULL THEN 'miss' ELSE 'hit' END AS state, n AS n_paths FROM q LEFT JOIN l ON l.s = q.s AND l.t = q.t AND k = 1""",
    "cached_search": _g0(_walk("(60,7),(2,20)", 4) + _SHOWN + " UNION ALL SELECT * FROM (VALUES (CAST(7 AS BIGINT), CAST(7 AS BIGINT), '7', 0), (101, 140, '101>57>734>598>140', 4), (101, 140, '101>2>3>4>140', 4))"),
    "long_paths_report": _g1(f""", {_walk(PAIRS, 4)} SELECT a.title AS source_title, b.title AS target_title, CAST(x.n AS INTEGER) AS first_path_vertices FROM (SELECT s, t, max(len(p)) AS n FROM found GROUP BY s, t) x
JOIN vertexes a ON a.id = s JOIN vertexes b ON b.id = t WHERE n >= 4 ORDER BY n DESC, a.title, b.title LIMIT 20"""),
    "top_pages_ranked": _g1(f", {_TOP} SELECT * FROM ranked"),
    "missing_top_pages": _g1(f", {_TOP} SELECT title, views, rank FROM articles ANTI JOIN vertexes USING (title)"),
    "top_graph_vertexes": _g1(f""", {_TOP}, {_TOP_GRAPH}, ids AS (SELECT DISTINCT ds.v AS id FROM dist JOIN ds ON ds.s = dist.s JOIN dt ON dt.t = dist.t AND dt.v = ds.v AND ds.d + dt.d = dist.d)
SELECT ids.id, v.title, top.rank IS NOT NULL AS top, top.rank FROM ids JOIN vertexes v ON v.id = ids.id LEFT JOIN top ON top.id = ids.id"""),
    "top_graph_edges": _g1(f""", {_TOP}, {_TOP_GRAPH} SELECT DISTINCT e.src, e.dst FROM dist JOIN ds ON ds.s = dist.s JOIN e ON e.src = ds.v JOIN dt ON dt.t = dist.t AND dt.v = e.dst AND ds.d + 1 + dt.d = dist.d
WHERE e.src IN (SELECT id FROM vertexes) AND e.dst IN (SELECT id FROM vertexes)"""),
    "sitemap_urls": f"{_SITEMAP} SELECT * FROM w",
    "sitemap_chunks": f"{_SITEMAP} SELECT chunk, CAST(count(*) AS INTEGER) AS n_urls, CAST(sum(length(url)) + {_URL_XML} * count(*) + {_EMPTY_XML} AS BIGINT) AS n_chars FROM w GROUP BY chunk",
    "dump_catalog": f"{_CATALOG} SELECT * FROM catalog",
    "dump_catalog_latest": f"{_CATALOG} SELECT '0.8' AS version, dump_date FROM catalog WHERE complete AND dump_date IS NOT NULL ORDER BY dump_date DESC LIMIT 1",
    "search_log_stats": """WITH l AS (SELECT e.user_id + 1 AS s, n.user_id + 1 AS t, CAST(round(e.value) AS BIGINT) AS ms FROM events e JOIN events n ON n.event_id = e.event_id + 1)
SELECT s AS source_page_id, count(*) AS n, count(DISTINCT t) AS n_targets, round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms FROM l GROUP BY s""",
    "graph_validate": _g1("""SELECT 'no_vertexes' AS "check", CAST(count(*) = 0 AS BIGINT) AS failures FROM vertexes UNION ALL SELECT 'bad_vertex_ids', count(*) FROM vertexes WHERE id IS NULL OR id <= 0
UNION ALL SELECT 'no_edges', CAST(count(*) = 0 AS BIGINT) FROM edges UNION ALL SELECT 'bad_edge_ids', count(*) FROM edges WHERE src IS NULL OR dst IS NULL OR src <= 0 OR dst <= 0
UNION ALL SELECT 'degree_difference', 0 UNION ALL SELECT 'ends_beyond_max_id', CAST(max(greatest(src, dst)) > (SELECT max(id) FROM vertexes) AS BIGINT) FROM edges"""),
    "item_list_jsonld": _g1(f""", {_walk(PAIRS, 4)}, firsts AS (SELECT s, t, min(p) AS p FROM found GROUP BY s, t), spots AS (SELECT s, t, unnest(range(1, len(p) + 1)) AS position, unnest(p) AS id FROM firsts)
SELECT s AS source_id, t AS target_id, CAST(position AS INTEGER) AS position, '{{"@type":"ListItem","position":' || position || ',"name":"' || title || '","url":"https://pages.example/' || replace(title, ' ', '_') || '"}}' AS item FROM spots JOIN vertexes USING (id)"""),
    "enriched_paths": _g1(f""", {_walk(PAIRS, 4)}{_SPOTS} SELECT DISTINCT s AS source_id, t AS target_id, CAST(position AS INTEGER) AS position, spots.id, v.title, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS description
FROM spots LEFT JOIN vertexes v ON v.id = spots.id LEFT JOIN customer ON c_custkey + 1 = spots.id"""),
    "html_link_extract": """SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS position, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)""",
}
