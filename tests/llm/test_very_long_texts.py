"""Texts beyond the 1 MB chunk, end to end, against plain versions."""
import binascii

import numpy as np
import pyarrow as pa
import tokenizers

from pathweave.llm import bytetext, decontam, html_main, ngram_join, packing, quality
from tests.llm.test_decontam import words
from tests.llm.test_ngram_join import shingles

RNG = np.random.default_rng(21)
LONG = " ".join(RNG.choice([f"word{i}" for i in range(20_000)], 160_000))
assert len(LONG) > 1_300_000


def test_decontamination(spark):
    item = " ".join(f"needle{i}" for i in range(12))
    docs = spark.createDataFrame([(1, LONG + " " + item), (2, LONG), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontam.contamination(docs, items).collect())
    n = len(words(LONG))
    assert got == [(1, n + 12, 12), (2, n, 0), (3, 12, 12)]


def test_near_duplicates(spark):
    other = " ".join(RNG.choice([f"else{i}" for i in range(20_000)], 150_000))
    docs = [(5, LONG), (4, LONG + " and an end"), (9, other), (2, "a short one of six words")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted((d, len(shingles(t)), 4 if d == 5 else d) for d, t in docs)


def test_packing(spark):
    model = tokenizers.Tokenizer.from_file(packing.tokenizer_files()["json"])
    rows = packing.pack(spark.createDataFrame([(1, LONG), (2, "short")], "doc_id long, text string")).collect()
    for doc, text in ((1, LONG), (2, "short")):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 0], np.uint32)
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist() and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == binascii.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) for r in pieces)


def test_statistics():
    one = next(iter(bytetext.chunks(pa.array([LONG]))))
    several = list(bytetext.chunks(pa.array(["a b", LONG, "c"])))
    assert len(several) == 3 and np.allclose(quality.statistics(one), quality.statistics(several[1])) and np.isfinite(quality.statistics(one)).all()


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "http://a/x", f"<nav>menu</nav><article><p>{LONG}</p></article>")], "page_id long, url string, html string")
    r = html_main.main_text(pages).first()
    assert r.text == LONG and r.n_chars == len(LONG)
