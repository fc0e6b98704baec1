"""Benchmark decontamination with a positional inverted index.

The index is sharded by document, as search engines do it: each segment holds
some whole documents with the postings (positions) of every term, so building
it shuffles nothing and a lost executor costs its segments only.  The index is
a stored table and serves any number of benchmarks.

A search takes the benchmark in blocks of bounded size.  In each segment, all
windows of a block are matched together: the terms of a window are ordered by
their number of postings, the candidates are the rarest term's positions less
its offset, and they are intersected with the offset-adjusted lists of the
other terms, rarest first.

Defined cases: a null or empty text has no words; benchmark rows without words
or with a null id give no window; repeated ids count once; repeated rows and
null doc_ids give a row each; a very long text is a chunk of its own and taken
whole.  Extra columns are not read.  Words are compared
by 64-bit hashes, so a window of ten words agrees in 640 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pathweave.llm import bytetext, scratch

WINDOW = 10
SEGMENT_BYTES = 3 << 20
#: Words of one block of benchmark items; a block is what a search broadcasts.
BLOCK_WORDS = 2_000_000
#: Candidate positions that are held at a time.
MAX_CANDIDATES = 2_000_000

INDEX_SCHEMA = "segment string, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, positions binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0)
        for chunk in bytetext.chunks(batch.column(1), SEGMENT_BYTES):
            w = bytetext.words(chunk, "alnum")
            counts = np.bincount(w.doc, minlength=chunk.last - chunk.first).astype(np.int32)
            # one free position after each document: no phrase crosses it
            position = (np.arange(len(w.doc)) + w.doc).astype(np.int32)
            order = np.argsort(w.hash, kind="stable")
            terms, df = np.unique(w.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{n}"]), pa.array([ids.slice(chunk.first, chunk.last - chunk.first).to_pylist()], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int32())), pa.array([bytetext.pack_sorted(terms)], pa.binary()),
                pa.array([bytetext.pack(df.astype(np.int32))], pa.binary()), pa.array([bytetext.pack_sorted(position[order])], pa.binary()),
            ], ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])
            n += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Stored index of all words of ``docs`` (doc_id, text), one row for each segment."""
    return _stored_index(docs)[0]


def _stored_index(docs: DataFrame) -> tuple[DataFrame, str]:
    return scratch.stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(bytetext.lean(_segments), INDEX_SCHEMA), "index")


class Segment:
    """Postings of one index row."""

    def __init__(self, row: dict):
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.terms = bytetext.unpack_sorted(row["terms"], np.uint64)
        self.counts = bytetext.unpack(row["counts"], np.int32).astype(np.int64)
        self.positions = bytetext.unpack_sorted(row["positions"], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc_start = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        # sorted by term, then position: one search finds whether a term stands at a position
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions

    def term_index(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == key)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases of equal length (rows of term hashes): (row, position) pairs."""
        found_rows, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        terms = self.term_index(windows)
        rows = np.flatnonzero((terms >= 0).all(axis=1))
        terms = terms[rows]
        df = self.counts[terms] if len(rows) else np.zeros(terms.shape, np.int64)
        order = np.argsort(df, axis=1, kind="stable")
        rarest = df.min(axis=1, initial=1 << 62)
        block = np.cumsum(rarest) // MAX_CANDIDATES if len(rows) else rarest
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            row = np.repeat(own, rarest[own])
            lead = order[own, 0]
            start = self.positions[bytetext.ragged(self.first[terms[own, lead]], rarest[own])] - np.repeat(lead, rarest[own])
            row, start = row[start >= 0], start[start >= 0]
            for k in range(1, windows.shape[1]):
                offset = order[row, k]
                keep = self.has(terms[row, offset], start + offset)
                row, start = row[keep], start[keep]
                if not len(row):
                    break
            found_rows.append(rows[row])
            found_at.append(start)
        return np.concatenate(found_rows), np.concatenate(found_at)

    def near(self, hashes: np.ndarray, distance: int, lead: np.uint64 | None = None) -> np.ndarray:
        """Positions of ``lead``, or else the rarest of some terms, that have each other term within ``distance`` words of the same document."""
        terms = self.term_index(np.unique(hashes))
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, np.int64)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        if lead is not None:
            first = self.term_index(np.array([lead], np.uint64))
            terms = np.concatenate([first, terms[terms != first]])
        start = self.positions[self.first[terms[0]] : self.first[terms[0] + 1]]
        doc = np.searchsorted(self.doc_start, start, "right") - 1
        low, high = np.maximum(start - distance, self.doc_start[doc]), np.minimum(start + distance, self.doc_start[doc + 1] - 1)
        keep = np.ones(len(start), bool)
        for t in terms[1:]:
            keep &= np.searchsorted(self.keys, (t << 32) | low) < np.searchsorted(self.keys, (t << 32) | high, "right")
        return start[keep]


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    return words[None, :] if len(words) < width else np.lib.stride_tricks.sliding_window_view(words, width)


def _hash_items(rows: list) -> list[tuple[str, np.ndarray]]:
    texts = pa.array([r.text for r in rows], pa.string())
    out = []
    for chunk in bytetext.chunks(texts):
        w = bytetext.words(chunk, "alnum")
        bounds = np.searchsorted(w.doc, np.arange(chunk.last - chunk.first + 1))
        out += [(rows[chunk.first + i].item_id, w.hash[bounds[i] : bounds[i + 1]]) for i in range(chunk.last - chunk.first)]
    return [(item, h) for item, h in out if len(h)]


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hits by document: (segment, ordinal, hits array<int>, items array<string>); hits are word numbers."""
    spark = index.sparkSession
    items = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    characters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + characters // (2 * BLOCK_WORDS)  # a word takes two characters at least, with its gap
    schema = "segment string, ordinal int, hits array<int>, items array<string>"
    parts = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(_by_length(_hash_items(own.collect()), window))
        part = index.mapInArrow(bytetext.lean(_searcher(held)), schema)
        if blocks > 1:  # one block's words are held at a time
            part = scratch.materialise(part, "hits")
            held.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("segment", "ordinal").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _by_length(items: list[tuple[str, np.ndarray]], window: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Windows of each length, distinct; (hashes, item number by window, item ids)."""
    ids = sorted({item for item, _ in items})
    number = {item: i for i, item in enumerate(ids)}
    by: dict[int, tuple[list, list]] = {}
    for item, words in items:
        w = _windows(words, window)
        hashes, owner = by.setdefault(w.shape[1], ([], []))
        hashes.append(w)
        owner.append(np.full(len(w), number[item]))
    return [(np.concatenate(h), np.concatenate(o), ids) for h, o in by.values()]


def _searcher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].as_py() for name in ("segment", "n_words", "terms", "counts", "positions")}
                yield from _search_segment(values, held.value)

    return run


def _search_segment(values: dict, queries: list) -> Iterator[pa.RecordBatch]:
    segment = Segment(values)
    mark = np.zeros(int(segment.doc_start[-1]) + 1, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    for hashes, owner, _ in queries:
        rows, at = segment.phrases(hashes)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + hashes.shape[1], -1)
        doc = np.searchsorted(segment.doc_start, at, "right") - 1
        pairs.append(np.unique(np.stack([doc, owner[rows]], axis=1), axis=0))
    hit = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    if not len(hit):
        return
    doc = np.searchsorted(segment.doc_start, hit, "right") - 1
    pairs = np.unique(np.concatenate(pairs), axis=0)
    docs = np.unique(doc)
    bounds, owners = np.searchsorted(doc, np.append(docs, 1 << 60)), np.searchsorted(pairs[:, 0], np.append(docs, 1 << 60))
    ids = queries[0][2]
    yield pa.RecordBatch.from_arrays([
        pa.array([values["segment"]] * len(docs)), pa.array(docs.astype(np.int32)),
        pa.array([(hit[a:b] - segment.doc_start[d]).astype(np.int32) for d, a, b in zip(docs, bounds, bounds[1:], strict=False)], pa.list_(pa.int32())),
        pa.array([[ids[i] for i in pairs[a:b, 1]] for a, b in zip(owners, owners[1:], strict=False)], pa.list_(pa.string())),
    ], ["segment", "ordinal", "hits", "items"])


def _finder(hashes: np.ndarray, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].as_py() for name in ("doc_ids", "n_words", "terms", "counts", "positions")}
                segment = Segment(values)
                at = segment.near(hashes, distance, hashes[0])
                if not len(at):
                    continue
                doc = np.searchsorted(segment.doc_start, at, "right") - 1
                docs, begins = np.unique(doc, return_index=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([values["doc_ids"][d] for d in docs], pa.int64()),
                    pa.array([a.astype(np.int32) for a in np.split(at - segment.doc_start[doc], begins[1:])], pa.list_(pa.int32())),
                ], ["doc_id", "positions"])

    return run


def proximity(index: DataFrame, text: str, distance: int) -> DataFrame:
    """(doc_id, positions) of the indexed rows where the first word of ``text`` has each other one within ``distance`` words; word numbers of the first."""
    schema = "doc_id bigint, positions array<int>"
    words = _hash_items([Row(item_id="", text=text)])
    return index.mapInArrow(bytetext.lean(_finder(words[0][1], distance)), schema) if words else index.sparkSession.createDataFrame([], schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items): one row for each row of ``docs``; a stored table."""
    index, path = _stored_index(docs)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("bigint").alias("n_words"))
    found = scratch.materialise(rows.join(search(index, benchmark, window), ["segment", "ordinal"], "left").select(
        "doc_id", "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")), "contamination")
    scratch.remove(docs.sparkSession, path)
    return found
