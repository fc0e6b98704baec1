import itertools
from collections import deque

import numpy as np
import pytest

from pathweave.operators import adjacency, bfs, blocks, paths
from pathweave.sources import tsv

HAND = [(1, 2), (1, 3), (1, 3), (2, 4), (2, 2), (3, 4), (4, 5), (6, 1)]
TSV = "1\t6,7\n4\t9\n5\t4\n6\t4\n7\t9\n9\t1,4,5\n"


def brute(edges, s, t):
    """All shortest paths by a plain search from s."""
    if s == t:
        return [[s]]
    out = {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
    far, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for w in out.get(v, []):
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
    if t not in far:
        return []
    found, stack = [], [[s]]
    while stack:
        p = stack.pop()
        if p[-1] == t:
            found.append(p)
        elif len(p) <= far[t]:
            stack += [[*p, w] for w in out.get(p[-1], []) if far[w] == len(p)]
    return sorted(p for p in found if len(p) == far[t] + 1)


def frames(spark, pairs, edges):
    return spark.createDataFrame(pairs, "source_id long, target_id long"), spark.createDataFrame(edges, "src long, dst long")


def found(spark, pairs, edges, block=blocks.BLOCK):
    out = {p: [] for p in pairs}
    p, e = frames(spark, pairs, edges)
    for r in bfs.shortest_paths(p, blocks.build(e, block=block)).collect():
        out[(r.source_id, r.target_id)].append(r.path)
    return {p: sorted(x) for p, x in out.items()}


@pytest.mark.parametrize("block", [1, blocks.BLOCK])
def test_hand_graph(spark, block):
    pairs = [(1, 4), (1, 5), (6, 5), (2, 2), (5, 1), (4, 9), (9, 9)]
    got = found(spark, pairs, HAND, block)
    assert got == {p: brute(HAND, *p) for p in pairs}
    assert got[(6, 5)] == [[6, 1, 2, 4, 5], [6, 1, 3, 4, 5]] and got[(5, 1)] == []


@pytest.mark.parametrize("block", [2, blocks.BLOCK])
def test_random_graphs(spark, block):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(1, 40, (110, 2))]
    pairs = [tuple(map(int, p)) for p in {tuple(p) for p in rng.integers(1, 42, (25, 2)).tolist()}]
    assert found(spark, pairs, edges, block) == {p: brute(edges, *p) for p in pairs}


def test_tsv_all_pairs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(TSV)
    lists = tsv.read_adjacency(spark, str(tmp_path / "a.tsv"))
    assert {r.id: r.outgoing for r in lists.collect()}[1] == [6, 7]
    edges = [(r.src, r.dst) for r in tsv.edges_of(lists).collect()]
    pairs = list(itertools.product([1, 4, 5, 6, 7, 9], repeat=2))
    got = found(spark, pairs, edges)
    assert all(len(p) == 1 for p in got.values())
    assert got[(5, 6)] == [[5, 4, 9, 1, 6]] and got[(6, 7)] == [[6, 4, 9, 1, 7]]


def test_counts_equal_lists(spark):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(1, 25, (120, 2))]
    pairs = [(1, 2), (3, 3), (4, 9), (7, 24), (1, 99)]
    p, e = frames(spark, pairs, edges)
    got = {(r.source_id, r.target_id): (r.degrees, int(r.n_paths)) for r in bfs.count_paths(p, e).collect()}
    want = {q: brute(edges, *q) for q in pairs}
    assert got == {q: (len(x[0]) - 1, len(x)) for q, x in want.items() if x}


def test_summary_and_layout(spark):
    pairs, edges = frames(spark, [(1, 5), (5, 1)], HAND)
    found_ = bfs.shortest_paths(pairs, edges)
    assert sorted((r["source_id"], r["count"], r["degrees"]) for r in paths.path_summary(pairs, found_).collect()) == [(1, 2, 3), (5, 0, None)]
    spots = {r.id: (r["rank"], round(r.x, 2), round(r.y, 2)) for r in paths.path_layout(found_).collect()}
    assert spots[1] == (2, 50, 4096) and spots[5] == (1, 8142, 4096) and spots[2] == (0, 2747.33, 400) and spots[3] == (0, 2747.33, 7792)


def test_adjacency_and_validate(spark):
    edges = spark.createDataFrame(HAND, "src long, dst long")
    vertexes = spark.createDataFrame([(i, str(i), False) for i in (1, 2, 3, 4, 5, 6, 9)], "id long, title string, is_redirect boolean")
    lists = {r.id: (r.outgoing, r.incoming) for r in adjacency.lists(blocks.build(edges, block=2), vertexes).collect()}
    assert lists[1] == ([2, 3, 3], [6]) and lists[9] == ([], []) and lists[2] == ([2, 4], [1, 2])
    assert all(r.failures == 0 for r in adjacency.validate(edges, vertexes).collect())
    bad = edges.unionByName(spark.createDataFrame([(0, 50)], "src long, dst long"))
    assert {r["check"]: r.failures for r in adjacency.validate(bad, vertexes).collect() if r.failures} == {"bad_edge_ids": 1, "ends_beyond_max_id": 1}
    none = spark.createDataFrame([], "src long, dst long")
    assert {r["check"] for r in adjacency.validate(none, vertexes).collect() if r.failures} == {"no_edges"}
    assert found(spark, [(1, 2), (3, 3)], [(8, 8)]) == {(1, 2): [], (3, 3): [[3]]}
