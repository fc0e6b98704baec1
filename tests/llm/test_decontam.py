import re

import numpy as np
import pytest

from pathweave.llm import bytetext, decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for x, owners in windows.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found |= owners
        out.append((-1 if doc is None else doc, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda: str(rng.choice(["a", "b", "é1", "日"]))
    items = [(i, " ".join(word() for _ in range(rng.integers(0, 16)))) for i in range(12)] + [(3, "b b b"), (None, "a a a"), (50, None), (51, "A-b? A b")]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(rng.integers(0, 30))]
        if rng.random() < 0.7:
            parts += ["X", *words(items[rng.integers(12)][1]), "Y"]
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(parts)))
    docs += [(70, None), (71, ""), (72, "..."), (5, docs[6][1]), (None, items[2][1])]
    frame = spark.createDataFrame([(a, str(b) if b is not None else None, "c") for a, b in docs], "doc_id long, text string, segment string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(frame, bench).collect())
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).count() == 0
    assert decontam.contamination(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bench).first().n_hit == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "b c d", "q", "f", "a b", "x y z"] * 3)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (5, 12), 2: (0, 0)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x x two x x x three"), (2, "three two one"), (3, "two three")], "doc_id long, text string").coalesce(1)
    rows = [r.asDict() for r in decontam.build_index(docs).collect()]
    word = lambda w: bytetext.words(bytetext.Chunk(0, 1, np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])), "alnum").hash[0]
    near = lambda n: sum(len(decontam.Segment(r).near(np.array([word("one"), word("two"), word("three")]), n)) for r in rows)
    assert near(1) == 0 and near(2) == 1 and near(7) == 2
