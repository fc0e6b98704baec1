"""Blocks of neighbours, and what a search has seen, kept in runs."""
import glob
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.operators import adjacency, bfs, blocks
from pathweave.plans.runs import Runs


def rows(graph):
    return graph.rows.collect()


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_hold_every_link_once(spark, block):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(-3, 20, (400, 2))] + [(7, i) for i in range(100)] * 2
    graph = blocks.build(spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long"), buckets=5, block=block)
    times = defaultdict(int)
    for a, b in edges:
        times["f", a, b] += 1
        times["b", b, a] += 1
    got, parts = {}, defaultdict(list)
    for r in rows(graph):
        assert len(r.w) <= block and r.w == sorted(set(r.w)) and r.slot == r.v * 2**25 + (2**24 if r.side == "b" else 0) + r.part
        got |= {(r.side, r.v, w): n for w, n in zip(r.w, r.times or [1] * len(r.w), strict=True)}
        parts[r.side, r.v].append((r.part, r.parts, r.links, r.w))
    assert got == times
    for (side, v), own in parts.items():
        own.sort()
        assert [p[0] for p in own] == list(range(own[0][1])) and {p[2] for p in own} == {sum(n for (s, x, _), n in times.items() if (s, x) == (side, v))}
        assert all(a[3][-1] < b[3][0] for a, b in zip(own, own[1:], strict=False))


def test_no_exchange_of_blocks_in_a_level(spark):
    graph = blocks.build(spark.range(1, 3000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst")), buckets=4)
    frontier = spark.range(1, 3000).select((F.col("id") * 2**25).alias("slot")).withColumn("pair_id", F.col("slot"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.joined(frontier, None, "w")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan


def test_a_vertex_of_five_million_neighbours_is_many_rows(spark):
    edges = spark.range(5_000_000).select(F.lit(9).cast("bigint").alias("src"), (F.col("id") * 3).alias("dst"))
    graph = blocks.build(edges, buckets=4)
    hub = graph.rows.filter("v = 9 and side = 'f'").agg(F.count("*").alias("n"), F.max(F.size("w")).alias("most"), F.max("parts").alias("parts"), F.sum(F.size("w")).alias("all")).first()
    assert hub["most"] <= blocks.BLOCK and hub["n"] == hub["parts"] >= 5_000_000 // blocks.BLOCK and hub["all"] == 5_000_000
    per_bucket = graph.rows.filter("v = 9 and side = 'f'").groupBy(F.input_file_name()).count().collect()
    assert len(per_bucket) == 4
    assert graph.neighbours(9).filter("side = 'f'").agg(F.sum(F.size("w"))).first()[0] == 5_000_000
    vertexes = spark.createDataFrame([(9, "hub")], "id long, title string")
    assert [(r.direction, r.id, r.title) for r in adjacency.read_edges(300, graph, vertexes).collect()] == [("in", 9, "hub")]


def test_ids_that_do_not_fit(spark):
    with pytest.raises(Exception, match="no room in a slot"):
        blocks.build(spark.createDataFrame([(2**38, 1)], "src long, dst long"))


def test_runs_are_a_set_and_reads_stay_small(spark, tmp_path):
    runs, known, sizes = Runs(spark, "seen", ["k"], 4), set(), []
    rng = np.random.default_rng(2)
    for level in range(40):
        keys = [level + 1000] if level % 5 else sorted({int(x) for x in rng.integers(0, 300, 30)})
        fresh = runs.extend(spark.createDataFrame([(k, level) for k in keys], "k long, level int"))
        assert sorted((r.k, r.level) for r in fresh.collect()) == [(k, level) for k in keys if k not in known]
        known |= set(keys)
        sizes.append(len(runs.folders([0])))
    assert {r.k for r in runs.all().collect()} == known
    assert max(sizes) <= 2 * 8


def test_what_a_level_reads_does_not_grow_with_the_levels_before(spark):
    runs, read = Runs(spark, "seen", ["k"], 16), []
    size = lambda folder: sum(os.path.getsize(p) for p in glob.glob(f"{folder.removeprefix('file://')}/*.parquet"))
    bucket = runs.bucket()
    of = {r.k: r.bucket for r in spark.range(64).select(F.col("id").alias("k")).withColumn("bucket", bucket).collect()}
    for level in range(64):  # a path: one vertex a level
        read.append(sum(map(size, runs.folders([of[level]]))))
        runs.extend(spark.createDataFrame([(level,)], "k long"))
    total = sum(map(size, runs.folders()))
    assert max(read[48:]) < total / 4 and np.mean(read[48:]) < 3 * np.mean(read[16:32])


def test_search_through_a_hub_of_many_blocks(spark):
    edges = [(1, 2)] + [(2, i) for i in range(100, 400)] + [(i, 3) for i in range(100, 400, 7)] + [(3, 4)]
    graph = blocks.build(spark.createDataFrame(edges, "src long, dst long"), block=8)
    pair = spark.createDataFrame([(1, 4)], "source_id long, target_id long")
    assert sorted(r.path for r in bfs.shortest_paths(pair, graph).collect()) == [[1, 2, i, 3, 4] for i in range(100, 400, 7)]
    assert [(r.degrees, int(r.n_paths)) for r in bfs.count_paths(pair, graph).collect()] == [(4, 43)]
