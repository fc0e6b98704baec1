import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pathweave.llm import bytetext, packing

SWAP = bytes.maketrans(b"ab", b"ba")


def twisted(n):
    """Two strings of n letters (a power of two) whose polynomial sums modulo 2**64 agree from some length on."""
    x = b"a"
    while len(x) < n:
        x += x.translate(SWAP)
    return x, x.translate(SWAP)


@pytest.mark.parametrize("n", [256, 1024, 2048])
def test_long_words_have_hashes_of_their_own(n):
    x, y = (s.decode() for s in twisted(n))
    chunk = next(bytetext.chunks(pa.array([f"{x} {y} {x}"])))
    for kind in ("alnum", "blank"):
        h = bytetext.words(chunk, kind).hash
        assert h[0] == h[2] != h[1]


def test_ids_of_long_words():
    x, y = (s.decode() for s in twisted(2048))
    files = packing.tokenizer_files()
    ids, ends = packing.Encoder(files).encode(next(bytetext.chunks(pa.array([x, y]))))
    whole = Tokenizer.from_file(files["json"])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in (x, y)]


def test_strings_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bytetext, "string_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    files, texts = packing.tokenizer_files(), ["one two", "six ten on", ""]
    ids, ends = packing.Encoder(files).encode(next(bytetext.chunks(pa.array(texts))))
    whole = Tokenizer.from_file(files["json"])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
