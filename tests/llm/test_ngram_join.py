import re

import numpy as np
import pytest

from pathweave.llm import components, ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((-1 if d is None else d, len(x), -1 if d is None else find(d)) for d, x in sets)


def corpus(seed):
    """Chains of edited copies, copies of copies, shared passages, short texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 4)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        text = [word() for _ in range(rng.integers(8, 150))]
        for _ in range(rng.integers(1, 9)):
            texts.append(list(text))
            for _ in range(rng.integers(0, 3)):
                text[rng.integers(len(text))] = word()
    for _ in range(10):
        texts.append([word() for _ in range(rng.integers(2, 12))] + passage)
    for _ in range(10):
        texts.append([str(rng.choice(["x", "y"])) for _ in range(rng.integers(0, 7))])
    rows = [" ".join(t) for t in texts]
    rows += [None, "", "  \n", " ", rows[0].upper(), rows[5], rows[5], rows[9] + "\n"]
    ids = rng.permutation(len(rows))
    return [(int(i), t) for i, t in zip(ids, rows)] + [(int(ids[0]), rows[30]), (None, rows[0]), (500, rows[0]), (500, rows[0])]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, n long, a int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.similar_documents(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("tile", [256, 4])
def test_tiles_of_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # copies that are near the threshold, each with its own edits
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            text[at] = f"e{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + a if a is not None else None, b) for a, b in corpus(1)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_prefixes_share_enough():
    """Any two similar sets share as many prefix tokens as the smaller multiple."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        excess = rng.choice([1.0, 1.0, 50.0], ngram_join.SKETCH).astype(np.float32)
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        k = int(rng.integers(0, n // 6 + 1))
        b[:k] = rng.integers(0, 1 << 63, k)
        both = [np.unique(x) for x in (a, b)]
        if 100 * len(np.intersect1d(*both)) < 75 * len(np.union1d(*both)):
            continue
        doc, token, multiple = ngram_join._prefixes(np.cumsum([0, *map(len, both)]), np.concatenate(both), excess)
        assert len(np.intersect1d(token[doc == 0], token[doc == 1])) >= multiple.min()


def test_empty_table(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(300, i) for i in range(200, 299)] + [(int(a), int(b)) for a, b in rng.integers(400, 480, (40, 2))]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
