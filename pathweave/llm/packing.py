"""Best-fit-decreasing packing of documents into sequences of bounded length.

Documents are tokenised once, in Arrow batches; what follows needs their
lengths only.  With sequences of at most ``capacity`` tokens there are at most
``capacity`` different lengths, so the packing is planned on counts by length:
a segment tree over remaining capacities finds the tightest open sequences in
logarithmic time, and all sequences in the same state are filled together as a
run.  The plan is exact best-fit decreasing over the whole corpus, its size
depends on ``capacity`` alone, and executors place each piece by its rank among
the pieces of its length.

Defined cases: a null text is empty and has the end token only; repeated rows
are separate documents; a very long text is a chunk of its own, encoded whole
and then cut; an empty table gives no row.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import bytetext, scratch

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Groups into which the pieces of one length are dealt for ranking.
SALTS = 64
#: Distinct strings that a worker keeps with their ids.
CACHE_STRINGS = 400_000
SPECIAL = "<|endoftext|>"
BATCH_BYTES = 1 << 20
#: Bytes of equal hashes compared at a time.
COMPARED_BYTES = 1 << 17


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"json": public_tokenizers.path(f"{TOKENIZER}.json"), "ranks": public_tokenizers.path(f"{TOKENIZER}.tiktoken")}


class Encoder:
    """Ids of whole texts, equal to those of the JSON tokenizer.

    The tokenizer splits a text before it merges, and always splits where a
    space or line feed follows something else, and where ASCII punctuation
    other than an apostrophe follows an ASCII letter.  So texts are cut there,
    each distinct string is encoded once, and ids are gathered from a table.
    """

    def __init__(self, files: dict[str, str]):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(files["ranks"], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(files["json"])
        self.parts = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()
        byte = np.arange(256)
        letter = ((byte | 32) >= 97) & ((byte | 32) <= 122)
        self.letter = letter
        self.mark = (byte > 32) & (byte < 127) & ~letter & ~((byte >= 48) & (byte <= 57)) & (byte != 39)
        self.gap = (byte == 32) | (byte == 10)
        self.solid = (byte > 32) & (byte < 127)

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.strings: list[bytes] = []
        self.ids = np.zeros(1 << 20, np.uint16)
        self.first = np.zeros(CACHE_STRINGS + 1, np.int64)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """True where a string begins."""
        cut = np.zeros(len(data), bool)
        cut[0] = True
        now, last = data[1:], data[:-1]
        # a byte beyond ASCII may end a Unicode space; of these only the ones led by C2, E1, E2, E3 exist
        safe = self.solid[last] | (last >= 128)
        lead = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        risky = lead[:-1].copy()
        risky[1:] |= lead[:-2]
        risky[2:] |= lead[:-3]
        cut[1:] = (self.gap[now] & safe & ~(risky & (last >= 128))) | (self.mark[now] & self.letter[last])
        return cut

    def encode(self, chunk: bytetext.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document), without end tokens."""
        n_docs, data = chunk.last - chunk.first, chunk.data
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(n_docs + 1, np.int64)
        raw = data.tobytes()
        if SPECIAL.encode() in raw:
            texts = [raw[a:b].decode() for a, b in zip(chunk.offsets, chunk.offsets[1:], strict=False)]
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.array(i, np.uint16) for i in ids]), np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        cut = self._cuts(data)
        cut[chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        hashes = bytetext.string_hashes(data, start, end)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_STRINGS:
            self.clear()
        size = max(CACHE_STRINGS, len(distinct)) + 1
        if len(self.first) < size:
            self.first = np.resize(self.first, size)
        known, slots, same = self.known, np.empty(len(distinct), np.int64), self._equal(data, start, end, where[inverse])
        for i, (h, at) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
            string, slot = raw[start[at] : end[at]], known.get(h)
            if slot is None:
                slot = known[h] = len(known)
                self.strings.append(string)
                ids = self.parts.encode_ordinary(string.decode())
                a, b = self.first[slot], self.first[slot] + len(ids)
                if b > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), b), np.uint16)])
                self.ids[a:b] = ids
                self.first[slot + 1] = b
            same = same and self.strings[slot] == string
            slots[i] = slot
        if not same:  # strings that differ have one hash: take them by their bytes
            return self._by_bytes(raw, start, end, chunk.offsets)
        slot = slots[inverse]
        lengths = self.first[slot + 1] - self.first[slot]
        ids = self.ids[bytetext.ragged(self.first[slot], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(start, chunk.offsets)]

    @staticmethod
    def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> bool:
        """Whether each string has the bytes of the string of number ``first``."""
        other = np.flatnonzero(first != np.arange(len(first)))
        lengths = (end - start)[other]
        if not (lengths == (end - start)[first[other]]).all():
            return False
        part = np.cumsum(lengths) // COMPARED_BYTES
        for own in np.split(np.arange(len(other)), np.flatnonzero(np.diff(part)) + 1) if len(other) else ():
            one, two = other[own], first[other[own]]
            if (data[bytetext.ragged(start[one], lengths[own])] != data[bytetext.ragged(start[two], lengths[own])]).any():
                return False
        return True

    def _by_bytes(self, raw: bytes, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known: dict[bytes, list[int]] = {}
        strings = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        for s in strings:
            if s not in known:
                known[s] = self.parts.encode_ordinary(s.decode())
        found = [known[s] for s in strings]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return np.array([i for x in found for i in x], np.uint16), ends[np.searchsorted(start, offsets)]


@cache
def _encoder(json: str, ranks: str) -> Encoder:
    return Encoder({"json": json, "ranks": ranks})


def _piece_maker(files: dict[str, str], capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(**files)
        for batch in batches:
            doc_ids = batch.column(0)
            for chunk in bytetext.chunks(batch.column(1), BATCH_BYTES):
                ids, offsets = encoder.encode(chunk)
                yield _cut(doc_ids.slice(chunk.first, chunk.last - chunk.first), ids, offsets, capacity, with_ids)

    return run


def _cut(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray, capacity: int, with_ids: bool) -> pa.RecordBatch:
    row, piece, start, length, crc, held = [], [], [], [], [], []
    for d in range(len(doc_ids)):
        own = np.append(ids[offsets[d] : offsets[d + 1]], END_ID).astype("<u4")
        at, k = 0, 0
        while at < len(own):
            n = (len(own) - 1) % capacity + 1 if not k else capacity
            row.append(d)
            piece.append(k)
            start.append(at)
            length.append(n)
            crc.append(zlib.crc32(own[at : at + n].tobytes()))
            if with_ids:
                held.append(own[at : at + n].astype(np.int32))
            at, k = at + n, k + 1
    columns = [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array(held, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, files: dict[str, str] | None = None) -> DataFrame:
    """Tokenise whole texts; only documents longer than ``capacity`` are cut, the first piece takes what is over."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        bytetext.lean(_piece_maker(files or tokenizer_files(), capacity, with_ids)), schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity with the runs of open sequences that have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)
        self.runs: dict[int, deque] = defaultdict(deque)

    def _set(self, room: int, value: bool) -> None:
        at = room + self.size
        while at and self.some[at] != value:
            self.some[at] = value
            at //= 2
            if at:
                value = bool(self.some[2 * at] or self.some[2 * at + 1])

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self._set(room, True)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of one run: (first, number)."""
        first, n = self.runs[room].popleft()
        if n > most:
            self.runs[room].appendleft((first + most, n - most))
            n = most
        if not self.runs[room]:
            self._set(room, False)
        return first, n

    def tightest(self, length: int) -> int | None:
        """Least remaining capacity of ``length`` or more that some open sequence has."""
        at = length + self.size
        if self.some[at]:
            return length
        while at > 1:
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing by counts of lengths.

    For each length a list of runs (first rank, first sequence, first offset,
    pieces a sequence): the pieces of that rank and after fill the sequences
    one by one, each with so many pieces beginning at that offset.
    """
    tree, opened, out = CapacityTree(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                tree.put(room, opened, -(-left // (room // length)))
                opened += -(-left // (room // length))
            # the tightest sequence stays the tightest until it is full for this length
            each = room // length
            if left >= each:
                first, n = tree.take(room, left // each)
            else:
                first, n, each = *tree.take(room, 1), left
            runs.append((rank, first, capacity - room, each))
            tree.put(room - each * length, first, n)
            rank, left = rank + n * each, left - n * each
        out[length] = runs
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``cut`` should be a stored table, it is read twice."""
    spark = cut.sparkSession
    whole, cut = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    groups = cut.groupBy("length", "salt").count().collect()  # capacity x SALTS rows at most
    totals: dict[int, int] = defaultdict(int)
    bases = []
    for g in sorted(groups, key=lambda g: (g.length, g.salt)):
        bases.append((g.length, g.salt, totals[g.length]))
        totals[g.length] += g["count"]
    runs = [(n, *map(list, zip(*r, strict=True))) for n, r in plan(totals, capacity).items()]
    bases = spark.createDataFrame(bases, "length bigint, salt int, base bigint")
    runs = spark.createDataFrame(runs, "length bigint, ranks array<bigint>, firsts array<bigint>, offsets array<bigint>, each array<bigint>")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(bases), ["length", "salt"]).join(F.broadcast(runs), "length")
    ranked = ranked.withColumn("rank", F.col("base") + F.col("n"))
    ranked = ranked.withColumn("run", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    at = {name: F.element_at(name, F.col("run")) for name in ("ranks", "firsts", "offsets", "each")}
    inside = F.col("rank") - at["ranks"]
    ranked = ranked.withColumn("sequence_id", at["firsts"] + F.floor(inside / at["each"]).cast("bigint")).withColumn(
        "offset", at["offsets"] + F.pmod(inside, at["each"]) * F.col("length")
    ).drop("salt", "n", "base", "ranks", "firsts", "offsets", "each", "rank", "run")
    # a piece that fills its sequence needs no rank: its sequence has a number below those of the others
    return ranked.unionByName(whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for all pieces of ``docs``."""
    return place(scratch.materialise(pieces(docs, capacity, with_ids), "pieces"), capacity)
