import gzip
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pathweave import cli
from pathweave.engine import GraphEngine
from pathweave.operators import cache, toppages
from pathweave.plans import manifest
from pathweave.sources import sqldump
from pathweave.streaming import search_log

TITLES = ["Alpha", "Beta_two", "Gamma", "Delta", "Old_name"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    dumps = tmp_path_factory.mktemp("dumps")
    page = spark.createDataFrame([(i + 1, 0, t, t == "Old_name") for i, t in enumerate(TITLES)], "page_id long, page_namespace int, page_title string, page_is_redirect boolean")
    target = spark.createDataFrame([(i + 100, 0, t) for i, t in enumerate(TITLES)] + [(200, 0, "Nowhere")], "lt_id long, lt_namespace int, lt_title string")
    links = spark.createDataFrame([(1, 0, 101), (1, 0, 102), (2, 0, 103), (3, 0, 103), (4, 0, 104), (4, 0, 200)], "pl_from long, pl_from_namespace int, pl_target_id long")
    redirect = spark.createDataFrame([(5, 0, "Alpha")], "rd_from long, rd_namespace int, rd_title string")
    for name, df in (("page", page), ("linktarget", target), ("pagelinks", links), ("redirect", redirect)):
        text = "\n".join(r.value for r in sqldump.render(df, name).collect())
        (dumps / f"wiki-20240501-{name}.sql.gz").write_bytes(gzip.compress(text.encode()))
    top = {"items": [{"project": "x", "articles": [{"article": t, "views": 9 - i, "rank": i + 1} for i, t in enumerate(["Alpha", "Missing", "Delta", "Beta_two"])]}]}
    (dumps / "top.json").write_text(json.dumps(top))
    assert cli.main(["--data", str(base), "build", "--dump-date", "20240501", "--dumps", str(dumps)], spark) == 0
    e = GraphEngine(spark, str(base))
    e.dumps = dumps
    return e


def test_status_and_lookups(engine):
    assert engine.dump_date == "20240501"
    assert engine.status() == {"date": "2024-05-01", "vertexCount": 5, "edgeCount": 6}
    assert engine.random_page(1)["id"] in {1, 2, 3, 4}
    assert all(r.failures == 0 for r in engine.validate().collect())
    assert sorted((r.direction, r.title) for r in engine.neighbors("Beta two").collect()) == [("in", "Alpha"), ("out", "Delta")]
    unresolved, broken = engine.failures()
    assert [tuple(r) for r in unresolved.collect()] == [(4, "Nowhere")] and broken.count() == 0


def test_paths_are_cached_and_logged(engine):
    got = engine.query(1, 4)
    assert got["paths"] == [[1, 2, 4], [1, 3, 4]] and got["count"] == 2 and got["degrees"] == 2
    before = engine.read("path").count()
    assert engine.query(1, 4)["paths"] == got["paths"] and engine.read("path").count() == before
    assert engine.query(2, 3)["degrees"] == 3  # through the redirect: 2 > 4 > 1 > 3
    assert engine.query(5, 4)["paths"] == [] and engine.query(5, 4)["degrees"] is None
    assert engine.search_log().count() == 5
    with pytest.raises(KeyError):
        engine.query(1, 77, validate=True)
    assert [r.source_title for r in engine.long_paths_report(4).collect()] == ["Beta two"]
    assert cache.search_log_stats(engine.search_log()).count() == 3


def test_command_line(engine, spark, capsys):
    data = ["--data", engine.base]
    assert cli.main([*data, "run", "Alpha", "Delta"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["Alpha → Beta two → Delta", "Alpha → Gamma → Delta"]
    assert cli.main([*data, "run", "Old name", "Delta"], spark) == 0 and "no path found" in capsys.readouterr().out
    assert cli.main([*data, "run", "Nope", "Delta"], spark) == 1
    assert cli.main([*data, "query", "Delta"], spark) == 0 and "in\t000000002\tBeta two" in capsys.readouterr().out
    assert cli.main([*data, "validate"], spark) == 0
    assert cli.main([*data, "status"], spark) == 0 and cli.main([*data, "random"], spark) == 0 and cli.main(["version"], spark) == 0


def test_top_graph_and_sitemap(engine, spark, capsys):
    top = str(engine.dumps / "top.json")
    assert cli.main(["--data", engine.base, "make-top-graph", "--top-pages", top], spark) == 0
    path = capsys.readouterr().out.strip()
    graph = json.loads(open(path).read())
    assert {(v["id"], v["top"], v["rank"]) for v in graph["vertexes"]} == {("1", True, 1), ("4", True, 2), ("2", True, 3), ("3", False, None)}
    assert {"source": "4", "target": "1"} in graph["edges"]
    assert cli.main(["--data", engine.base, "sitemap", "--top-pages", top, "--base-url", "https://s.example"], spark) == 0
    files = capsys.readouterr().out.split()
    assert files == ["sitemap-0.xml.gz", "sitemap-index.xml.gz"]
    tree = ET.fromstring(gzip.decompress(open(f"{engine.folder}/sitemaps/sitemap-0.xml.gz", "rb").read()))
    places = [u[0].text for u in tree]
    assert places[:3] == ["https://s.example", "https://s.example/paths/1/4", "https://s.example/paths/1/2"] and len(places) == 7


def test_small_chunks_keep_the_order(spark):
    top = spark.createDataFrame([(i * 7, i) for i in range(1, 6)], "id long, rank int")
    rows = toppages.sitemap_urls(top, "b", per_file=4).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(21)) and [r.chunk for r in rows] == [i // 4 for i in range(21)]


def test_publish_and_resume(engine, spark):
    assert manifest.current(spark, engine.base) == "20240501"
    again = engine.build({}, publish=False)  # finished stages need no tables
    assert again.build_complete and again.resolved_edge_count == 5
    other = GraphEngine(spark, engine.base, "20240401")
    manifest.save(spark, other.folder, manifest.Manifest(dump_date="20240401"))
    assert manifest.publish(spark, engine.base, "20240501", clean=True) == ["20240401"]


def test_search_log_stream(spark, tmp_path):
    rows = [(1, 2, f"2024-05-01 0{h}:0{m}:00", m) for h in (1, 2) for m in range(3)]
    spark.createDataFrame(rows, "source_page_id long, target_page_id long, t string, duration long").withColumn("timestamp", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "log"))
    stream = search_log.searches_by_window(search_log.read_log(spark, str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("searches").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.hour, r.n, r.max_ms) for r in spark.sql("select * from searches").collect()) == [(1, 3, 2), (2, 3, 2)]
