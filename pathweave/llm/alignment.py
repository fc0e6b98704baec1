"""Cross-tokenizer alignment: where the tokens of two tokenizers share bytes of a text, and where they end together.

A text is read with one space in front, as the second tokenizer (B) puts it
there itself.  The owner of each byte is found for both tokenizers by repeating
token numbers over their bytes: consecutive distinct pairs of owners are the
overlaps, and where both owners change the text is cut into groups.  The tokens
that end at a cut are linked, and links are counted over the whole corpus by
their pair of ids.

Both tokenizers always end a token where a space follows something that is no
white space (the first splits there before it merges, and no entry of the
second's vocabulary has a space behind another character, which is checked when
it is loaded).  So texts are taken apart there, and the tokens, groups and links
of each distinct part are made once and put together by document.

Counts are joined back in two ways.  Pairs that hold more than a fixed share of
all links are few by that share, and are broadcast; all others are joined by a
shuffle, in which no pair can be hot.

Defined cases: texts that are null or empty, or whose joined bytes by A or B
differ from space and text (a literal U+2581, say), have no tokens: zeros and an
empty digest.  The strings of special tokens are plain text.  Repeated rows and
doc_ids are separate documents, null ids too.  A very long text is handled alone
and whole; a part of many characters is not held for later texts.  Extra columns
are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import bytetext, scratch

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of more than one in so many links are broadcast: fewer pairs than this.
COMMON = 1 << 16
#: Parts that a worker keeps, the characters of the longest one, and the tokens of all.
CACHE_PARTS, CACHE_CHARS, CACHE_TOKENS = 250_000, 256, 4_000_000
_B_BITS = 32
_SPACE = "▁"


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"a": public_tokenizers.path(TOKENIZER_A), "b": public_tokenizers.path(TOKENIZER_B)}


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable ones of Latin-1 stand for themselves, others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Overlaps and cuts of two token sequences over the same bytes."""

    #: (token of A, token of B) that share bytes, in order
    over_a: np.ndarray
    over_b: np.ndarray
    #: tokens of A and B that end at a cut; what lies between two cuts is a group
    cut_a: np.ndarray
    cut_b: np.ndarray


def align(length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """By the bytes of each token of A and B, whose sums are equal."""
    owner_a, owner_b = (np.repeat(np.arange(len(n)), n) for n in (length_a, length_b))
    if not len(owner_a):
        none = np.zeros(0, np.int64)
        return Aligned(none, none, none, none)
    new_a, new_b = np.diff(owner_a) != 0, np.diff(owner_b) != 0
    first = np.flatnonzero(np.concatenate([[True], new_a | new_b]))
    last = np.flatnonzero(np.concatenate([new_a & new_b, [True]]))
    return Aligned(owner_a[first], owner_b[first], owner_a[last], owner_b[last])


class Tokenizers:
    """Token ids and their bytes by both tokenizers, for parts that follow a space."""

    def __init__(self, files: dict[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files["a"])
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for text, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=files["b"])
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in b], np.int64) for b in (self.bytes_a, self.bytes_b))
        #: no piece has a space behind another character: texts may be taken apart there
        self.parts = not any(y == _SPACE and x != _SPACE for p in pieces for x, y in zip(p, p[1:], strict=False))

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids by A and B of space and part, and whether both give back its bytes."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        whole = [(" " + p).encode() for p in parts]
        same = [b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, w in zip(a, b, whole, strict=True)]
        return a, b, same


class Parts:
    """Tables of distinct parts: numbers of tokens, the text of their groups, and the pairs of their links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        #: by part: tokens of A and B, groups, overlaps; -1 tokens where the bytes differ
        self.numbers = np.zeros((0, 4), np.int64)
        self.text: list[str] = []
        self.pairs = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def add(self, new: list[str]) -> None:
        """Tables of ``new`` parts, whose slots follow those that are there."""
        a, b, same = self.tokenizers.encode(new)
        a, b = ([x if s else [] for x, s in zip(ids, same, strict=True)] for ids in (a, b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        ids_a, ids_b = (np.fromiter((t for x in ids for t in x), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        found = align(self.tokenizers.length_a[ids_a], self.tokenizers.length_b[ids_b])
        end_a = np.cumsum(n_a)
        # tokens of both end where a part ends, so that no group or overlap crosses parts
        group, over = (np.bincount(np.searchsorted(end_a, at, "right"), minlength=len(new)) for at in (found.cut_a, found.over_a))
        self.text += self._texts(ids_a.tolist(), ids_b.tolist(), found, group)
        counts = np.stack([n_a, n_b, group, over], 1)
        counts[~np.array(same, bool)] = -1
        self.numbers = np.concatenate([self.numbers, counts])
        self.pairs = np.concatenate([self.pairs, (ids_a[found.cut_a] << _B_BITS) | ids_b[found.cut_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(group)])

    @staticmethod
    def _texts(ids_a: list[int], ids_b: list[int], found: Aligned, group: np.ndarray) -> list[str]:
        words_a, words_b, out, at_a, at_b = list(map(str, ids_a)), list(map(str, ids_b)), [], 0, 0
        ends = zip((found.cut_a + 1).tolist(), (found.cut_b + 1).tolist(), strict=True)
        for n in group.tolist():
            groups = []
            for _ in range(n):
                to_a, to_b = next(ends)
                groups.append(",".join(words_a[at_a:to_a]) + "|" + ",".join(words_b[at_b:to_b]))
                at_a, at_b = to_a, to_b
            out.append(";".join(groups))
        return out

    def slots(self, texts: list[list[str]]) -> list[list[int]]:
        """Slots of the parts of each text."""
        new = dict.fromkeys(p for parts in texts for p in parts if p not in self.slot)
        if len(self.slot) + len(new) > CACHE_PARTS or len(self.pairs) > CACHE_TOKENS:
            self.clear()
            new = dict.fromkeys(p for parts in texts for p in parts)
        if new:
            start = len(self.text)
            self.add(list(new))
            self.slot.update((p, start + i) for i, p in enumerate(new))
        out = [[self.slot[p] for p in parts] for parts in texts]
        for p in [p for p in new if len(p) > CACHE_CHARS]:
            del self.slot[p]
        return out

    def split(self, text: str) -> list[str]:
        """Parts of a text, each without the space that it follows."""
        if not self.tokenizers.parts:
            return [text]
        out: list[str] = []
        held: list[str] = []
        for p in text.split(" "):
            held.append(p)
            if p and not p[-1].isspace():
                out.append(p if len(held) == 1 else " ".join(held))
                held = []
        if held:  # white space at the end of the text, which is no part by itself
            out[-1:] = [" ".join([*out[-1:], *held])]
        return out


_loaded: dict[tuple, Parts] = {}


def _parts(files: dict[str, str]) -> Parts:
    """Of this worker."""
    key = tuple(sorted(files.items()))
    if key not in _loaded:
        _loaded[key] = Parts(Tokenizers(files))
    return _loaded[key]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_overlaps", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_OUT_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _documents(table: Parts, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    slots = table.slots([table.split(t) if t else [] for t in texts])
    columns: dict[str, list] = {name: [] for name in _OUT.names[1:]}
    for own in slots:
        at = np.array(own, np.int64)
        counts = table.numbers[at]
        fine = len(at) > 0 and int(counts.min()) >= 0
        a, b, groups, over = counts.sum(0).tolist() if fine else (0, 0, 0, 0)
        pairs, times = np.unique(table.pairs[bytetext.ragged(table.first[at], table.first[at + 1] - table.first[at])], return_counts=True) if fine else ((), ())
        digest = hashlib.sha256(";".join(map(table.text.__getitem__, own)).encode()).hexdigest() if fine else ""
        for name, value in zip(columns, (a, b, groups, groups, over, digest, pairs, times), strict=True):
            columns[name].append(value)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, _OUT.field(k).type) for k, v in columns.items())], schema=_OUT)


def tokens(docs: DataFrame, files: dict[str, str] | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, times): the alignment of each document.

    ``pairs`` are the distinct pairs of ids linked, id of A * 2**32 + id of B, and ``times`` their numbers in the document.
    """
    files = files or tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _parts(files)
        for batch in batches:
            sizes = np.array([len(s.as_buffer()) if s.is_valid else 0 for s in batch.column("text")], np.int64)
            ends, first = np.cumsum(sizes), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + bytetext.CHUNK_BYTES, "right")))
                some = batch.slice(first, last - first)
                texts = [(s.as_buffer().to_pybytes().decode("utf-8", "replace") if s.is_valid else "") for s in some.column("text")]
                yield _documents(table, some.column("doc_id"), texts)
                first = last

    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text"))
    return rows.mapInArrow(bytetext.lean(run), _OUT_DDL)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the corpus-wide links of each pair of ids, and whether no other pair of its id of B has more."""
    counts = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    # an id of B has as many pairs as A has ids at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def align_documents(docs: DataFrame, files: dict[str, str] | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256) of every document."""
    found, path = scratch.stored(tokens(docs, files, id_column, column).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts, _ = scratch.stored(pair_counts(found), "pairs")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // COMMON
    common, others = counts.filter(F.col("n") > least), counts.filter(F.col("n") <= least)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # fewer than COMMON rows, by the share that each of them has
    near = links.join(F.broadcast(common), "pair")
    far = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(others, "pair")
    part = lambda df: df.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    sums = part(near).unionByName(part(far)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out, _ = scratch.stored(found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", zero("n_best"), zero("count_sum"), "groups_sha256"), "alignment")
    scratch.remove(docs.sparkSession, path)
    return out
