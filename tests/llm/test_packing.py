import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pathweave.llm import packing

TEXTS = [
    "", None, "a", "Hello  world", "don't  stop\n\n\nnow ", "  lead", "tab\tand\r\nline", "été à la plage , ñandú", "a b c　 d",
    "x<|endoftext|>y <|endoftext|>", "word " * 5000, "!!! ### a.b,c;d 12.5% $3 it's we'll", "😀 👍🏽 ok", "\u0085 x \x1c y \x0b z", "日本語 テキスト 。 終わり", "trail   ",
]


def brute_fill(lengths, capacity):
    """Best-fit decreasing, one piece after the other: number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = defaultdict(list)
    for n, runs in packing.plan(counts, capacity).items():
        for rank in range(counts[n]):
            first, seq, offset, each = max(r for r in runs if r[0] <= rank)
            used[seq + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    rooms = []
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
        rooms.append(capacity - at)
    assert sorted(rooms) == brute_fill(lengths, capacity)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, length string")
    rows = packing.pack(docs, with_ids=True).collect()
    t = Tokenizer.from_file(packing.tokenizer_files()["json"])
    by = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in got[::2] for x in r.ids] == want
        assert [r.start for r in got[::2]] == [sum(x.length for x in got[::2][:k]) for k in range(len(got[::2]))]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == len(brute_fill([r.length for r in rows], 2048))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
