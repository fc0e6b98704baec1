"""Alignment against whole texts encoded at once and plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pathweave.llm import alignment, queries

FILES = alignment.tokenizer_files()


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES["a"])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES["b"])


def brute(texts, models):
    """Rows of whole texts, by loops."""
    a, b = models
    name = {i: t for t, i in a.get_vocab().items()}
    letters = alignment.byte_letters()
    found, count = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        byte_a = [bytes(letters[c] for c in name[i]) for i in ids_a]
        byte_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(byte_a) == b"".join(byte_b) == (" " + text).encode():
            found.append(None)
            continue
        ends = [[0], [0]]
        for e, tokens in zip(ends, (byte_a, byte_b), strict=True):
            for t in tokens:
                e.append(e[-1] + len(t))
        links = [(ids_a[i], ids_b[ends[1].index(end) - 1]) for i, end in enumerate(ends[0][1:]) if end in set(ends[1])]
        groups, start = [], (0, 0)
        for end in sorted(set(ends[0][1:]) & set(ends[1][1:])):
            to = ends[0].index(end), ends[1].index(end)
            groups.append(",".join(map(str, ids_a[start[0]:to[0]])) + "|" + ",".join(map(str, ids_b[start[1]:to[1]])))
            start = to
        over = sum(1 for i in range(len(ids_a)) for j in range(len(ids_b)) if max(ends[0][i], ends[1][j]) < min(ends[0][i + 1], ends[1][j + 1]))
        count.update(links)
        found.append((len(ids_a), len(ids_b), len(groups), links, over, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(0, 0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), f[4], sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[5]) for f in found]


ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b\n", "▁a", "x <|endoftext|> y", "<s> </s> <unk> <0x41>", "été naïve 東京 \U0001f600‍\U0001f3fd x", "tab\tand\x0bmore\x1c x",
       "  nbsp   em", "can't won't I'll", "\x00 nul", "12345 3.14 -7", "ﬁ ﬂ Å é", "a" * 3000, "!?" * 200 + " x", "   lead and trail   "]


def test_equals_whole_texts(spark, models):
    rng = random.Random(1)
    words = ["the", "Straße", "ciónci", "x=1;", "don't", "foo\nbar", "", "9807915762804490", "a.b@c.de", "東", "-\t-", " "]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    texts += [texts[-1], texts[-1]]
    rows = [(None if i == 30 else i // 2, t, 1) for i, t in enumerate(texts)]
    got = alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    want = Counter((r[0], *w) for r, w in zip(rows, brute(texts, models), strict=True))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want


def test_counts_when_all_pairs_are_rare_or_common(spark, models, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat", "réveil naïve", "the the the"]
    want = sorted(w[5:7] for w in brute(texts, models))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for common in (1, 1 << 40):
        monkeypatch.setattr(alignment, "COMMON", common)
        assert sorted((r.n_best, r.count_sum) for r in alignment.align_documents(docs).collect()) == want


def test_parts_that_do_not_fit_the_cache(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_PARTS", 3)
    monkeypatch.setattr(alignment, "CACHE_CHARS", 2)
    texts = ["one two three four", "four three", "x y z", "one one"]
    table = alignment.Parts(alignment.Tokenizers(FILES))
    for _ in range(2):
        for t, want in zip(texts, brute(texts, models), strict=True):
            [slots] = table.slots([table.split(t)])
            assert hashlib.sha256(";".join(table.text[s] for s in slots).encode()).hexdigest() == want[7]


def test_owner_arrays():
    found = alignment.align(np.array([3, 1, 2]), np.array([1, 2, 3]))
    assert found.over_a.tolist() == [0, 0, 1, 2] and found.over_b.tolist() == [0, 1, 2, 2]
    assert found.cut_a.tolist() == [0, 2] and found.cut_b.tolist() == [1, 2]
    assert not len(alignment.align(np.zeros(0, np.int64), np.zeros(0, np.int64)).cut_a)


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_text(spark, models):
    text = "word and Wörter, " * 70_000 + "z" * 20_000
    a, b = models
    [r] = alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(text) > 1_000_000 and (r.n_a, r.n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))


def test_query(spark, models):
    got = queries.op11_alignment(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if r.text is None or len(r.text) < 1500]
    want = {r.doc_id: w for r, w in zip(short, brute([r.text for r in short], models), strict=True)}
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in got.collect()}
    assert len(found) == len(rows) and all(found[d] == (*w[:4], w[7]) for d, w in want.items())
