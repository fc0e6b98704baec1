import hashlib

import numpy as np
import pytest

from pathweave.llm import fingerprint


def rows_of(spark, docs):
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, tuples int")
    return sorted((r.asDict() for r in fingerprint.fingerprints(frame).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["edited_sha256"]))


def expected(docs):
    """Hash of the edited text of each row."""
    order = sorted(docs, key=lambda d: (-(1 << 63) if d[0] is None else d[0], [-ord(c) for c in d[1] or ""]), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_edited_texts(spark, n):
    rng = np.random.default_rng(n)
    ids = rng.choice(1000, n, replace=False).tolist()
    docs = [(i, "".join(rng.choice(list("abé 日\n"), rng.integers(0, 50)))) for i in ids]
    docs = [(a, str(b)) for a, b in docs] + ([(2000, None), (None, "null id"), (2001, "")] if n > 5 else [])
    got = rows_of(spark, docs)
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == expected(docs)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_likeness_falls_with_edits_and_order(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 400, 600)]
    variants = [words]
    for k in (10, 60, 200):
        x = list(words)
        for at in rng.choice(600, k, replace=False):
            x[at] = f"new{at}"
        variants.append(x)
    blocks = [words[i : i + 20] for i in range(0, 600, 20)]
    variants.append([w for b in rng.permutation(len(blocks)) for w in blocks[b]])
    variants.append([f"other{i}" for i in range(600)])
    frame = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(variants)], "i int, text string")
    prints = {r.i: r.f for r in frame.select("i", fingerprint.fingerprint(frame["text"]).alias("f")).collect()}
    near = lambda a, b: len(set(a) & set(b)) / len({x >> 58 for x in a} | {x >> 58 for x in b})
    like = [near(prints[0], prints[i]) for i in range(6)]
    assert like[0] == 1 and like[0] > like[1] > like[2] > like[3] and like[5] == 0
    # the moved blocks keep nearly all k-mers, but not their order
    assert like[4] < 0.8


def test_equal_texts_and_occurrences(spark):
    docs = [(1, "a b c a b c a b c"), (2, "a b c a b c a b c"), (3, "a b c"), (4, "a b c a b c"), (5, ""), (6, None), (6, None)]
    prints = {r["doc_id"]: r["fingerprint"] for r in rows_of(spark, docs)}
    assert prints[1] == prints[2] and len({prints[1], prints[3], prints[4], prints[5]}) == 4 and prints[5] == prints[6] != ""


def test_empty_table(spark):
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
