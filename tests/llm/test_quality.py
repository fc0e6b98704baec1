import binascii

import numpy as np
import pyarrow as pa

from pathweave.llm import bytetext, quality


def chunk(texts):
    return next(iter(bytetext.chunks(pa.array(texts, pa.string()))))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.93
    # one row after the other, node by node
    for row, s in zip(x[2000:2020], score, strict=False):
        total = model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] + int(row[model.feature[node]] > model.cut[node])
            total += model.value[node]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", None, "a", "Hello, World! " * 30, "x\ny\n\nx", "ÉTÉ à 12%", "word " * 1000, "\n", " "]
    together = quality.statistics(chunk(texts))
    alone = np.concatenate([quality.statistics(chunk([t])) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_one_label_only_and_none():
    x = np.zeros((3, 2), np.float32)
    assert (quality.fit(x, np.ones(3)).score(x) > 0.99).all() and (quality.fit(x, np.zeros(3)).score(x) < 0.01).all()
    assert (quality.fit(x[:0], np.zeros(0)).score(x) > 0.99).all()


def test_held_out_labels_do_not_matter(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["good", "words", "here"], 30)) + ("%%% ***" * 5 if i % 3 == 0 else ""), None) for i in range(300)] + [(None, "x", None), (5, None, None), (400, "", None), (400, "", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    held = lambda i: binascii.crc32(str(i).encode()) % 4 == 2
    scores = []
    for flip in (False, True):
        labels = [(i, int(i % 3 != 0) ^ int(flip and held(i)), None) for i in range(300)] + [(1, None, None), (None, 0, None)]
        model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
        scores.append(sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 12)) for r in quality.score(frame, model, ["doc_id"]).collect()))
    assert scores[0] == scores[1] and len(scores[0]) == len(docs)
    right = [(s >= 0.7) == (i % 3 != 0) for i, s in scores[0] if 0 <= i < 300 and i != 5 and held(i)]
    assert np.mean(right) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(frame, quality.train(frame, none), ["doc_id"]).filter("score < 0.99").count() == 0
    assert quality.score(frame.limit(0), quality.train(frame.limit(0), none), ["doc_id"]).count() == 0
