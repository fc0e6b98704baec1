import gzip
import json

from pathweave.operators import resolve
from pathweave.sources import jsonapi, sqldump, sqltuples

DUMP = r"""-- comment line, skipped
INSERT INTO `page` VALUES (1,0,'Exploding_animal',0,0,0.5,'20240101000000',NULL,10,20,'wikitext',NULL),(2,0,'It\'s_(a),trap',1,0,0.25,'20240101000000','20240101000000',11,21,'wikitext',NULL),(3,1,'Talk_page',0,0,0.75,'20240101000000',NULL,12,22,'wikitext',NULL);
INSERT INTO `linktarget` VALUES (100,0,'It\'s_(a),trap'),(101,0,'Back\\slash'),(102,4,'Other_ns');
INSERT INTO `pagelinks` VALUES (1,0,100),(1,0,101),(3,1,100),(1,0,102);
INSERT INTO `redirect` VALUES (2,0,'Exploding_animal',NULL,NULL);
INSERT INTO `redirect` VALUES (9,0,'Broken',NULL),(8,0,'cut
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dump_text(spark, tmp_path):
    path = tmp_path / "dump.sql.gz"
    path.write_bytes(gzip.compress(DUMP.encode()))
    lines = sqldump.read_lines(spark, str(path), 2)
    tables = {name: sqldump.parse(lines, name) for name in ("page", "linktarget", "pagelinks", "redirect")}
    g = resolve.resolve(tables)
    assert rows(g["vertexes"]) == [(1, "Exploding animal", False), (2, "It's (a),trap", True)]
    assert rows(g["links"]) == [(1, "Back\\slash"), (1, "It's (a),trap")]
    assert rows(g["redirects"].filter("from_id = 2")) == [(2, 1)]
    assert rows(g["edges"]) == [(1, 1)]
    assert rows(g["unresolved_links"]) == [(1, "Back\\slash")]
    assert sorted(r.error for r in sqltuples.malformed(lines, "redirect").collect()) == ["4 values where 5 are due", "string not closed"]
    for name in ("page", "linktarget", "pagelinks"):
        assert rows(sqltuples.parse(lines, name)) == rows(tables[name])


def test_render_and_parse(spark):
    titles = ["a'b", "back\\", "\\n", "line\nfeed", 'q"q', "(x),(y)", "", "é_日本", "tab\there", None]
    df = spark.createDataFrame([(i, i % 2, t, i % 3 == 0) for i, t in enumerate(titles)], "page_id long, page_namespace int, page_title string, page_is_redirect boolean")
    back = sqldump.parse(sqldump.render(df, "page", 4), "page").select(df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_single_hop_and_failures(spark):
    vertexes = spark.createDataFrame([(1, "a", False), (2, "r1", True), (3, "r2", True), (4, "dead", True)], "id long, title string, is_redirect boolean")
    redirects = spark.createDataFrame([(2, 3), (3, 1)], "from_id long, to_id long")
    links = spark.createDataFrame([(9, "r1"), (9, "r2"), (9, "dead"), (9, "none"), (9, "a"), (9, "a")], "src long, dest_title string")
    assert rows(resolve.edges(links, vertexes, redirects)) == [(9, 1), (9, 1), (9, 1), (9, 3)]
    assert rows(resolve.redirect_failures(vertexes, redirects)) == [(4, "dead", True)]


def test_json(spark):
    jobs = {j: {"status": "done", "updated": "2024-06-02 00:00:00", "files": {}} for j in ("redirecttable", "pagetable", "pagepropstable", "pagelinkstable", "linktargettable")}
    docs = spark.createDataFrame([(json.dumps({"version": "1", "jobs": jobs}),), ("not json",)], "value string")
    assert [(r.complete, r.dump_date, r.n_dates) for r in jsonapi.dump_catalog(docs).collect()][0] == (True, None, 0)
    assert jsonapi.latest_dump(jsonapi.dump_catalog(docs)).count() == 0
    info = json.dumps({"query": {"pages": {"1": {"pageid": 1, "ns": 0, "title": "A"}, "-1": {"ns": 0, "title": "B", "missing": ""}, "3": {"pageid": 3, "ns": 1, "title": "C"}}}})
    assert rows(jsonapi.page_info(spark.createDataFrame([(info,)], "value string"))) == [(1, "A")]
