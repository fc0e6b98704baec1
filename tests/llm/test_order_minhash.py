"""The fingerprint against a plain Order MinHash written element by element."""
import re
from collections import Counter

import numpy as np
import xxhash

from pathweave.llm import fingerprint as fp

MASK = (1 << 64) - 1


def chained(*values):
    """Hash of several values, each seeded with the hash of those before it; numbers as (value, bytes)."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v[0] & ((1 << 8 * v[1]) - 1)).to_bytes(v[1], "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def plain(text):
    """{bucket: tuple hash}: elements are numbered k-mers, two least of each bucket in text order."""
    words = re.split(r"[\x09-\x0D\x20]+", text or "")
    # trailing empty words stay, as the operator's split keeps them
    kmers = [(chained(*words[i : i + fp.K]) >> 24, i) for i in range(max(len(words) - fp.K, 0) + 1)]
    seen, elements = Counter(), []
    for h, i in kmers:
        elements.append((chained((h, 8), (seen[h], 4)) >> 24, i))
        seen[h] += 1
    out = {}
    for bucket in range(fp.BUCKETS):
        least = sorted(e for e in elements if e[0] >> 34 == bucket)[:2]
        in_order = [h for h, _ in sorted(least, key=lambda e: e[1])]
        if in_order:
            out[bucket] = (bucket << 58) | (chained(*[(h, 8) for h in in_order]) >> 6)
    return out


def as_string(p):
    """Numbers in the order of a signed 64-bit sort, so that buckets of the upper half stand first."""
    return "".join(f"{x:016x}" for x in sorted(p.values(), key=lambda x: x - (1 << 64) if x >> 63 else x))


def like(a, b):
    return len(set(a.values()) & set(b.values())) / len(a.keys() | b.keys())


def test_equals_plain_order_minhash(spark):
    rng = np.random.default_rng(8)
    texts = ["", None, "a", "a b", "a b c", " a  b\tc\n", "x y z " * 40, "été 日本 " * 9]
    texts += [" ".join(rng.choice([f"w{i}" for i in range(size)], n)) for size, n in ((3, 50), (30, 300), (5000, 2000), (5000, 1))]
    docs = list(enumerate(texts))
    rows = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        after = texts[i - 1] or ""
        text = text or ""
        cut = len(text) // 3
        own, edited = plain(text), plain(text[: len(text) - cut] + after[:cut])
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == (as_string(own), as_string(edited)), i
        assert abs(r.near_edited - like(own, edited)) < 1e-12 and abs(r.near_next - like(own, plain(after))) < 1e-12


def test_text_over_a_megabyte(spark):
    rng = np.random.default_rng(9)
    text = " ".join(rng.choice([f"word{i}" for i in range(900)], 160_000))
    assert len(text) > 1_100_000
    frame = spark.createDataFrame([(1, text), (2, text), (3, text + " end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.fingerprints(frame).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint == as_string(plain(text))
    assert rows[2].near_next == 1.0 and rows[3].near_next > 0.9
