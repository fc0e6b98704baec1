"""Title index, prefix search through redirects, ranks, sitemap files written by tasks, and the order of redirect rows."""
import gzip
import os
import re
import subprocess
import sys
import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from pathweave.operators import lookup, ranking, resolve, toppages
from pathweave.sources import sqldump


def rows_read(df):
    """Rows that the scan of a query gave, after it has run."""
    df.collect()
    leaves, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.children().isEmpty():
            leaves.append(node)
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(x.metrics().apply("numOutputRows").value() for x in leaves)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    pages = spark.range(1, 60_001).select(F.col("id"), F.concat(F.lit("Page "), F.lpad(((F.col("id") * 7919) % 60_000).cast("string"), 6, "0")).alias("title"), (F.col("id") % 10 == 0).alias("is_redirect"))
    redirects = pages.filter("is_redirect and id % 20 = 0").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id"))
    path = str(tmp_path_factory.mktemp("titles"))
    lookup.write_titles(lookup.titles(pages, redirects), path, group_bytes=32 << 10)
    return pages, spark.read.parquet(path)


def test_title_lookup_reads_few_rows(spark, index):
    pages, titles = index
    found = lookup.by_title(titles, "Page_012345")
    assert [r.id for r in found.collect()] == [r.id for r in lookup.by_title(pages, "Page 012345").collect()]
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(title,Page 012345)" in plan and rows_read(found) < 20_000 == titles.count() / 3
    assert lookup.by_title(titles, "Page 0123456").collect() == []
    some = titles.filter(F.col("title").startswith("Page 0123"))
    assert "StringStartsWith(title,Page 0123)" in some._jdf.queryExecution().toString() and rows_read(some) < 20_000


def test_prefix_search_follows_redirects(spark):
    pages = spark.createDataFrame([(1, "Aa", False), (2, "Ab", True), (3, "Ac", True), (4, "Zed", False), (5, "Ad", True), (6, "Ae", False), (7, "Af", False), (8, "B", False)], "id long, title string, is_redirect boolean")
    redirects = spark.createDataFrame([(2, 4), (3, 1), (1, 8)], "from_id long, to_id long")
    got = [tuple(r) for r in lookup.search_prefix(lookup.titles(pages, redirects), "A").collect()]
    # Ab leads to Zed, Ac back to Aa, Ad nowhere; page 1 is no redirect, whatever the map says
    assert got == [(1, 1, "Aa"), (2, 4, "Zed"), (4, 5, "Ad"), (5, 6, "Ae")]
    assert lookup.search_prefix(lookup.titles(pages, redirects), "Q").collect() == []


def test_ranks_of_three_million_rows_without_one_task(spark):
    rows = spark.range(3_000_000).select(F.col("id"), (F.col("id") * 48_271 % 1_000).alias("views"))
    got = ranking.numbered(rows, ["views", "id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number()" in plan and "windowspecdefinition(_range" in plan
    # rank of (views, id): rows with fewer views, and those of as many with a lesser id; each value of views has 3,000 ids
    bad = got.groupBy("views").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.countDistinct("rank").alias("d")).filter("lo <> views * 3000 + 1 or hi <> views * 3000 + 3000 or n <> 3000 or d <> 3000")
    assert bad.count() == 0
    some = got.filter("views in (0, 499)").select("views", "id", "rank").collect()
    for views in (0, 499):
        own = sorted((r.id, r["rank"]) for r in some if r.views == views)
        assert [k for _, k in own] == list(range(views * 3000 + 1, views * 3000 + 3001))


def test_rank_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(3, "x"), (None, "a"), (1, "b"), (1, "a"), (3, "x")], "k int, _range string")
    assert sorted((r["rank"], r.k, r._range) for r in ranking.numbered(df, ["k", "_range"]).collect()) == [(1, None, "a"), (2, 1, "a"), (3, 1, "b"), (4, 3, "x"), (5, 3, "x")]
    assert ranking.numbered(df.filter("false"), ["k"]).collect() == []


@pytest.mark.parametrize("block", [2, 250])
def test_pairs_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(toppages, "PAIR_BLOCK", block)
    top = spark.createDataFrame([(i * 10, i) for i in range(1, 8)], "id long, rank int")
    plan = toppages.pairs(top)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.s, r.t) for r in toppages.pairs(top).collect()) == [(s, t) for s in range(1, 8) for t in range(1, 8) if s != t]
    assert toppages.pairs(top.filter("false")).collect() == []


def test_sitemap_files(spark, tmp_path):
    top = spark.createDataFrame([(i * 10, i) for i in range(1, 8)], "id long, rank int")
    urls = toppages.sitemap_urls(top, "https://x.example/?a=1&b=<2>", per_file=10)
    for _ in range(2):  # writing again replaces
        names = toppages.write_sitemap(spark, urls, str(tmp_path / "maps"), "https://x.example/?a=1&b=<2>")
    want = ["https://x.example/?a=1&b=<2>"] + [f"https://x.example/?a=1&b=<2>/paths/{s}0/{t}0" for s in range(1, 8) for t in range(1, 8) if s != t]
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    assert names == [*[f"sitemap-{i}.xml.gz" for i in range(5)], "sitemap-index.xml.gz"] == [*sorted(p.name for p in (tmp_path / "maps").glob("sitemap-?.xml.gz")), "sitemap-index.xml.gz"]
    found = []
    for i in range(5):
        root = ElementTree.fromstring(gzip.decompress((tmp_path / "maps" / names[i]).read_bytes()))
        assert root.tag == f"{space}urlset" and all(u.find(f"{space}changefreq").text == "monthly" for u in root)
        found.append([u.find(f"{space}loc").text for u in root])
    assert [len(x) for x in found] == [10, 10, 10, 10, 3] and sum(found, []) == want
    index = ElementTree.fromstring(gzip.decompress((tmp_path / "maps" / names[-1]).read_bytes()))
    assert [s.find(f"{space}loc").text for s in index] == [f"https://x.example/?a=1&b=<2>/sitemaps/{n}" for n in names[:-1]]
    assert not list((tmp_path / "maps").glob("chunks*"))


RETRY = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pathweave.operators import toppages

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/scratch").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def fail_once(batches):
    yield from batches
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

top = spark.createDataFrame([(i, i) for i in range(1, 30)], "id long, rank int")
urls = toppages.sitemap_urls(top, "https://x.example", per_file=100)
write = type(urls).sortWithinPartitions
type(urls).sortWithinPartitions = lambda self, *c: (lambda rows: rows.mapInArrow(fail_once, rows.schema))(write(self, *c))
names = toppages.write_sitemap(spark, urls, sys.argv[1] + "/maps", "https://x.example")
print("files", len(names))
"""


def test_a_task_that_is_tried_again_leaves_one_file(tmp_path):
    """The first attempt of each writing task fails after its last row, in a session that tries tasks again."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)
    assert "files 10" in run.stdout, run.stderr[-2000:]
    assert len(list((tmp_path / "maps").glob("*.gz"))) == 10
    found = [u for p in sorted((tmp_path / "maps").glob("sitemap-?.xml.gz")) for u in re.findall("<loc>([^<]*)</loc>", gzip.decompress(p.read_bytes()).decode())]
    assert len(found) == len(set(found)) == 1 + 29 * 28


def test_last_redirect_row_wins(spark, tmp_path):
    pages = spark.createDataFrame([(1, "A", False), (9, "B", False)], "id long, title string, is_redirect boolean")
    row = lambda page, title: f"({page},0,'{title}','','')"
    filler = [f"INSERT INTO `redirect` VALUES {row(i, 'None')};" for i in range(100, 160)]
    lines = ["-- dump", f"INSERT INTO `redirect` VALUES {row(5, 'A')},{row(5, 'B')},{row(6, 'B')},{row(6, 'A')};", f"INSERT INTO `redirect` VALUES {row(7, 'A')};", *filler, f"INSERT INTO `redirect` VALUES {row(7, 'B')},{row(8, 'B')},{row(8, 'None')};"]
    for turned in (False, True):
        path = tmp_path / f"r{turned}.sql.gz"
        path.write_bytes(gzip.compress("\n".join(reversed(lines) if turned else lines).encode()))
        parsed = sqldump.parse(sqldump.read_lines(spark, str(path), partitions=7), "redirect")
        got = {r.from_id: r.to_id for r in resolve.redirects(parsed, pages).collect()}
        # of rows whose title no page has none is written
        assert got == {5: 9, 6: 1, 7: 1 if turned else 9, 8: 9}
