import hashlib

import numpy as np
import pytest

from pathweave.llm import bytetext, suffix_dedup


def brute(rows, length):
    """Result of each (doc_id, text) by a dictionary of all strings."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        key = 1 << 62 if doc is None else doc
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(least.get(s, 1 << 62), key)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        key = 1 << 62 if doc is None else doc
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((-1 if doc is None else doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    syllables = ["th", "an", "é", " ", "in", "\n", "er "]
    word = lambda k: "".join(rng.choice(syllables, k))
    shared = [word(int(k)) for k in rng.integers(20, 120, 8)]
    rows = []
    for i in range(n):
        parts = [word(int(rng.integers(0, 60))) if rng.random() < 0.5 else shared[rng.integers(8)][int(rng.integers(0, 20)) :] for _ in range(rng.integers(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "ab" * 100), (n + 5, "ab" * 60), (5, rows[6][1]), (None, rows[7][1])]
    rng.shuffle(rows)
    return [(None if a is None else int(a), b if b is None else str(b)) for a, b in rows]


@pytest.mark.parametrize("seed,part", [(0, None), (1, 300), (2, 128)])
def test_equals_brute_force(spark, monkeypatch, seed, part):
    if part:  # texts longer than a part; only in effect where Python workers share this process's setting
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, version int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute(rows, 50)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    raw = data.tobytes()
    start = rng.integers(0, 400, 150)
    end = np.minimum(400, start + rng.integers(0, 60, 150))
    group = np.sort(rng.integers(0, 5, 150))
    prefix = bytetext.prefix_hashes(bytetext.BYTE_VALUES[data])
    order = suffix_dedup.suffix_sort(data, prefix, start, end, group)
    assert [(g, raw[start[i] : end[i]]) for g, i in zip(group, order)] == sorted((g, raw[a:b]) for g, a, b in zip(group, start, end))


@pytest.mark.parametrize("part", [64, 100, 1000])
def test_parts_cover_each_window_once(monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    data = np.random.default_rng(0).integers(97, 100, 900).astype(np.uint8)
    chunk = bytetext.Chunk(0, 1, data, np.array([0, 900]))
    seen = []
    for _, shift, piece, offsets in suffix_dedup._parts(chunk, 50):
        place, a, b, gram, _ = suffix_dedup.anchors(piece, offsets)
        for p, x, y in zip(place, a, b):
            assert x <= p + 0 and all(s <= p <= s + 34 for s in range(x, y + 1))
            seen += range(x + shift, y + shift + 1)
    assert sorted(seen) == list(range(851))
