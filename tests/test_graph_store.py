"""The stored graph: searches over it, long paths, scratch tables, the redirect rule and small functions."""
import datetime
import glob
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave import cli, functions
from pathweave.engine import GraphEngine
from pathweave.operators import adjacency, bfs, blocks, resolve
from pathweave.plans import storage
from tests.test_graph import brute, frames
from tests.test_index_and_ranks import rows_read


def listed(df):
    return sorted((r.source_id, r.target_id, tuple(r.path)) for r in df.collect())


def expected(pairs, edges):
    return sorted((s, t, tuple(p)) for s, t in pairs for p in brute(edges, s, t))


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_stored_graph_gives_the_same_paths(spark, monkeypatch, small):
    monkeypatch.setattr(blocks, "SMALL", small)
    rng = np.random.default_rng(11)
    edges = [tuple(map(int, e)) for e in rng.integers(1, 30, (70, 2))]
    pairs = sorted({tuple(map(int, p)) for p in rng.integers(1, 32, (15, 2))})
    p, e = frames(spark, pairs, edges)
    graph = blocks.build(e, block=3)
    assert listed(bfs.shortest_paths(p, graph)) == expected(pairs, edges)
    assert listed(bfs.shortest_paths(p, e)) == expected(pairs, edges)


def test_no_limit_of_levels(spark):
    chain = [(i, i + 1) for i in range(1, 25)]
    p, e = frames(spark, [(1, 25), (25, 1)], chain)
    assert [r.path for r in bfs.shortest_paths(p, e).collect()] == [list(range(1, 26))]


def test_pairs_without_a_search(spark):
    p, e = frames(spark, [(3, 3)], [(1, 2)])
    assert listed(bfs.shortest_paths(p, e)) == [(3, 3, (3,))]
    assert bfs.shortest_paths(p.limit(0), e).count() == 0


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    page = spark.createDataFrame([(i, 0, f"P{i}", i == 6) for i in range(1, 7)], "page_id long, page_namespace int, page_title string, page_is_redirect boolean")
    target = spark.createDataFrame([(i + 100, 0, f"P{i}") for i in range(1, 7)], "lt_id long, lt_namespace int, lt_title string")
    links = spark.createDataFrame([(1, 0, 102), (1, 0, 103), (2, 0, 104), (3, 0, 106), (4, 0, 105), (2, 0, 102)], "pl_from long, pl_from_namespace int, pl_target_id long")
    redirect = spark.createDataFrame([(6, 0, "P1"), (6, 0, "P4")], "rd_from long, rd_namespace int, rd_title string")
    e = GraphEngine(spark, str(tmp_path_factory.mktemp("store")), "20240501")
    e.build({"page": page, "linktarget": target, "pagelinks": links, "redirect": redirect})
    return e


def test_build_stores_what_searches_read(engine):
    assert [(r.from_id, r.to_id) for r in engine.read("redirects").collect()] == [(6, 4)]
    status = json.loads(storage.read_bytes(engine.spark, f"{engine.folder}/status.json"))
    assert status["distinct_edge_count"] == 5 and status["stage_rows"]["blocks"] == 8 and status["buckets"] == 4 and set(status["stage_seconds"]) == set(status["stage_rows"])
    assert all(rate >= 0 for rate in engine.build({}, publish=False).rates().values())
    one = engine.graph.at([3 << 25])
    plan = one._jdf.queryExecution().toString()
    # of four buckets one is read
    assert "Exchange" not in plan and f"EqualTo(slot,{3 << 25})" in plan and one.count() == 1 <= rows_read(one) < 8


def test_query_leaves_no_scratch_and_reads_no_graph_when_cached(engine, monkeypatch):
    folder = storage.scratch_dir(engine.spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/pathweave-*"))
    got = engine.query(1, 5)
    assert got["paths"] == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert set(glob.glob(f"{folder}/pathweave-*")) == before

    def refuse(*_, **__):
        raise AssertionError("searched a cached pair")

    monkeypatch.setattr(bfs, "shortest_paths", refuse)
    assert engine.query(1, 5)["paths"] == got["paths"]


def test_neighbours_from_stored_lists(engine):
    key = lambda r: (r.direction, r.id, r.title)
    for page in range(1, 7):
        stored = sorted(map(key, adjacency.read_edges(page, engine.graph, engine.vertexes).collect()))
        assert stored == sorted(map(key, adjacency.neighbors(page, engine.edges, engine.vertexes).collect()))


def test_probe_and_small_files(engine, spark, tmp_path):
    found = engine.probe(3)
    assert {found["source"], found["target"]} < {1, 2, 3, 4, 5} and found["count"] == len(found["paths"])
    path = f"{tmp_path}/pointer"
    for text in (b"one", b"two"):
        storage.write_bytes(spark, path, text)
        assert storage.read_bytes(spark, path) == text
    assert storage.children(spark, str(tmp_path)) == ["pointer"]


def test_redirect_rows_of_one_page(spark):
    v = spark.createDataFrame([(1, "A", False), (9, "B", False)], "id long, title string, is_redirect boolean")
    rd = spark.createDataFrame([(5, 0, "B"), (5, 0, "A"), (7, 0, "A"), (8, 0, "None")], "rd_from long, rd_namespace int, rd_title string")
    assert sorted(map(tuple, resolve.redirects(rd, v).collect())) == [(5, 9), (7, 1)]


def test_dates(spark):
    day = F.lit(datetime.date(2024, 3, 31))
    row = spark.range(1).select(functions.previous_month(day).alias("m"), functions.days_before(day, 31).alias("d"), functions.previous_month(F.lit(datetime.date(2024, 1, 5))).alias("y")).first()
    assert tuple(row) == ("2024/02", "20240229", "2023/12")


def test_find_latest_urls_and_dump_check(spark, tmp_path, capsys):
    from pathweave.schema import DUMP_JOBS

    job = lambda name: {"status": "done", "updated": "2024-05-02 01:02:03", "files": {f"{name}.gz": {"size": 1, "url": f"/wiki/20240501/{name}.gz", "md5": "m", "sha1": "s"}}}
    (tmp_path / "status").mkdir()
    (tmp_path / "status" / "dumpstatus.json").write_text(json.dumps({"version": "0.8", "jobs": {j: job(j) for j in DUMP_JOBS}}))
    base = ["--data", str(tmp_path / "data"), "find-latest", str(tmp_path / "status"), "--urls"]
    assert cli.main([*base, "--relative"], spark) == 0
    relative = capsys.readouterr().out.split()
    assert cli.main([*base, "--host", "https://mirror.example/"], spark) == 0
    assert len(relative) == len(DUMP_JOBS) and capsys.readouterr().out.split() == ["https://mirror.example" + u for u in relative]
    for name, text in (("page", "INSERT INTO `page` VALUES (1,0,'A',0),(2,0,'B;\n"), ("redirect", ""), ("pagelinks", ""), ("linktarget", "INSERT INTO `linktarget` VALUES (1,0,'A');\n")):
        (tmp_path / f"w-20240501-{name}.sql.gz").write_bytes(gzip.compress(text.encode()))
    e = GraphEngine(spark, str(tmp_path / "data"), "20240501")
    assert sorted((r.file, r.n, r.error) for r in e.malformed(str(tmp_path), "w").collect()) == [("page", 0, "4 values where 12 are due"), ("page", 1, "string not closed")]
    assert cli.main(["--data", e.base, "build", "--dump-date", "20240501", "--dumps", str(tmp_path), "--prefix", "w", "--strict"], spark) == 1
    assert "page: 1 tuples not loaded: string not closed" in capsys.readouterr().err and not (tmp_path / "data").exists()
