"""Documents whose sets of word 5-shingles have a Jaccard similarity of 0.75 or more.

Candidates come from adaptive multi-match prefixes.  A set's tokens (hashed
shingles) are put in one global order, the frequent ones last.  For a multiple
m, the prefix of a set of n tokens has n - ceil(0.75 n) + m tokens, and two
sets that are similar share m tokens of their prefixes, m being the smaller of
their multiples.  Each document takes the multiple for which reading its lists
and verifying its candidates is estimated to cost least; frequencies come from
a count of all shingles in a table of fixed size.

Pairs are not listed within a group of copies.  Equal sets are one class.  In
each token's list the other documents are paired with the first one only, and
the best of these pairs of each document is verified.  Verified pairs are
contracted; what remains is every pair of a common list whose documents are
still in different components, so that no link between components is missed.
The documents of a first document's lists are dealt to tiles twice, and
compared there as matrices, without a row for a pair: first by their tokens of
these lists, which says who may have a partner at all, then those by their
whole texts.  A document takes part for the first documents that it cannot do
without: leaving out those with the fewest shared tokens, as long as they sum
to less than a partner must share.  A similar pair shares, under one of the
rest at least, its due part of the tokens that it must share in all.

Defined cases: a null or empty text has no shingle and no link; a text of fewer
than five words has one; rows of one doc_id are one vertex; a null doc_id has a
null component and no link; a very long text is a chunk of its own and taken
whole.  Extra columns are not read.  Shingles are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import bytetext, components, scratch

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 75
SKETCH = 1 << 16
MULTIPLES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Cost of verifying a candidate, in list entries read, for each shingle.
VERIFY_COST = 0.05
GROUP_BYTES = 16 << 20


def shingle_sets(chunk: bytetext.Chunk, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by document, distinct shingle hashes, ascending within a document)."""
    n = chunk.last - chunk.first
    w = bytetext.words(chunk, "blank")
    count = np.bincount(w.doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    base = np.uint64(bytetext.BASE)
    h = np.zeros(0, np.uint64)
    if len(w.hash) >= shingle:
        h = w.hash[: len(w.hash) - shingle + 1].copy()
        for i in range(1, shingle):
            h = h * base + w.hash[i : len(h) + i]
    inside = w.doc[: len(h)] == w.doc[shingle - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[: len(h)][inside], bytetext.mix(h[inside])
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        tails = np.array([_fold(w.hash[first[d] : first[d + 1]]) for d in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, bytetext.mix(tails + np.uint64(1))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
    return np.searchsorted(doc[keep], np.arange(n + 1)), h[keep]


def _fold(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * bytetext.BASE + h) % (1 << 64)
    return total


def set_hashes(bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever the order of its members."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(bytetext.mix(hashes ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and hashes of each document; how many shingles fall in each cell of the sketch."""
    names = ["doc_id", "n", "h1", "h2", "cell"]
    cells = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for chunk in bytetext.chunks(batch.column(1)):
            bounds, hashes = shingle_sets(chunk)
            cells += np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=SKETCH)
            h1, h2 = set_hashes(bounds, hashes)
            k = chunk.last - chunk.first
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, k), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), pa.nulls(k, pa.int32())], names)
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(cells[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32))], names)


def _prefixes(bounds: np.ndarray, hashes: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, multiple by document) of all prefixes."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weight = excess[(hashes >> np.uint64(48)).astype(np.int64)]
    frequency = np.floor(np.log2(weight)).astype(np.int8)
    order = np.lexsort((hashes, frequency, doc))
    hashes, weight = hashes[order], weight[order]
    needed = -(-PERCENT * sizes // 100)
    base = sizes - needed
    read = np.concatenate([[0], np.cumsum(weight, dtype=np.float64)])
    multiple, best = np.ones(len(sizes), np.int64), np.full(len(sizes), np.inf)
    for m in MULTIPLES:
        entries = read[np.minimum(bounds[:-1] + base + m, bounds[1:])] - read[bounds[:-1]]
        # a candidate takes m list entries at least
        cost = entries + entries / m * VERIFY_COST * sizes
        better = (cost < best) & (m <= needed)
        multiple, best = np.where(better, m, multiple), np.where(better, cost, best)
    length = np.where(sizes > 0, base + multiple, 0)
    take = bytetext.ragged(bounds[:-1], length)
    return doc[take], hashes[take], multiple


_POSTINGS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("n", pa.binary()), ("multiple", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("tokens", pa.binary()), ("owner", pa.binary())])
POSTINGS_SCHEMA = "bucket int, docs binary, n binary, multiple binary, h1 binary, h2 binary, tokens binary, owner binary"


def _post(group: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Prefix postings of a group of documents, equal sets once, dealt to buckets by token."""
    doc, n, h1, h2, multiple = (np.concatenate([g[k] for g in group]) for k in range(5))
    shift = np.cumsum([0, *(len(g[0]) for g in group)])
    owner = np.concatenate([g[5] + s for g, s in zip(group, shift, strict=False)])
    token = np.concatenate([g[6] for g in group])
    order = np.lexsort((doc, h2, h1, n))
    same = np.r_[False, (n[order][1:] == n[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
    keep = np.zeros(len(doc), bool)
    keep[order[~same]] = True
    mine = keep[owner]
    owner, token = owner[mine], token[mine]
    bucket = (token % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((token, bucket))
    owner, token, bucket = owner[order], token[order], bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        used, local = np.unique(owner[a:b], return_inverse=True)
        yield pa.RecordBatch.from_pylist([{
            "bucket": int(bucket[a]), "docs": bytetext.pack(doc[used]), "n": bytetext.pack(n[used].astype(np.int32)), "multiple": bytetext.pack(multiple[used].astype(np.int8)),
            "h1": bytetext.pack(h1[used]), "h2": bytetext.pack(h2[used]), "tokens": bytetext.pack_sorted(token[a:b] // np.uint64(buckets)), "owner": bytetext.pack(local.astype(np.int32)),
        }], _POSTINGS)


def _poster(held, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        excess, group, size = held.value, [], 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in bytetext.chunks(batch.column(1)):
                bounds, hashes = shingle_sets(chunk)
                owner, token, multiple = _prefixes(bounds, hashes, excess)
                group.append((doc[chunk.first : chunk.last].astype(np.int64), np.diff(bounds), *set_hashes(bounds, hashes), multiple, owner, token))
                size += len(chunk.data)
                if size >= GROUP_BYTES:
                    yield from _post(group, buckets)
                    group, size = [], 0
        if group:
            yield from _post(group, buckets)

    return run


_LISTS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("n", pa.binary()), ("multiple", pa.binary()), ("classes", pa.binary()), ("lengths", pa.binary()), ("members", pa.binary())])
LISTS_SCHEMA = "bucket int, docs binary, n binary, multiple binary, classes binary, lengths binary, members binary"


def _gather(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Lists of a bucket that have two documents or more, by document number; the least doc_id stands first."""
    field = lambda name, kind: np.concatenate([bytetext.unpack(r[name], kind) for r in rows])
    doc, n, multiple, h1, h2 = field("docs", np.int64), field("n", np.int32), field("multiple", np.int8), field("h1", np.int64), field("h2", np.int64)
    shift = np.cumsum([0, *(int.from_bytes(r["docs"][:8], "little") for r in rows)])
    owner = np.concatenate([bytetext.unpack(r["owner"], np.int32) + s for r, s in zip(rows, shift, strict=False)])
    token = np.concatenate([bytetext.unpack_sorted(r["tokens"], np.uint64) for r in rows])
    rank = np.lexsort((h2, h1, doc))
    doc, n, multiple, h1, h2 = doc[rank], n[rank], multiple[rank], h1[rank], h2[rank]
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    owner = place[owner]
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    lengths = np.diff(np.append(start, len(token)))
    several = lengths > 1
    members = owner[bytetext.ragged(start[several], lengths[several])]
    used, local = np.unique(members, return_inverse=True)
    if len(used):
        _, classes = np.unique(np.stack([n[used].astype(np.int64), h1[used], h2[used]], axis=1), axis=0, return_inverse=True)
        yield pa.RecordBatch.from_pylist([{
            "bucket": rows[0]["bucket"], "docs": bytetext.pack(doc[used]), "n": bytetext.pack(n[used]), "multiple": bytetext.pack(multiple[used]),
            "classes": bytetext.pack(classes.reshape(-1).astype(np.int32)), "lengths": bytetext.pack(lengths[several].astype(np.int32)), "members": bytetext.pack(local.astype(np.int32)),
        }], _LISTS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from _gather(held)
                held = []
            held.append(row)
    if held:
        yield from _gather(held)


class Lists:
    """Lists of a bucket: members[first[i]:first[i + 1]] are numbers of documents, ascending by doc_id."""

    def __init__(self, row: dict):
        self.doc = bytetext.unpack(row["docs"], np.int64)
        self.n = bytetext.unpack(row["n"], np.int32).astype(np.int64)
        self.multiple = bytetext.unpack(row["multiple"], np.int8).astype(np.int64)
        self.classes = bytetext.unpack(row["classes"], np.int32)
        self.lengths = bytetext.unpack(row["lengths"], np.int32).astype(np.int64)
        self.members = bytetext.unpack(row["members"], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length filter."""
        return 100 * np.minimum(self.n[a], self.n[b]) >= PERCENT * np.maximum(self.n[a], self.n[b])


STARS_SCHEMA = "a bigint, hub bigint, n int, multiple int, needed int, shared int, possible boolean, same boolean, lowest int, tokens binary"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list's documents paired with its first one; ``lowest`` is the least that a partner in these lists must share.

    The first one has a row too, with itself; ``tokens`` are 32-bit names of the lists.
    """
    for batch in batches:
        for row in batch.to_pylist():
            x = Lists(row)
            hub = np.repeat(x.members[x.first[:-1]], x.lengths)
            lists = np.repeat(np.arange(len(x.lengths)), x.lengths)
            # partners of a size that may be similar are in the same class of sizes or the next ones
            size = np.floor(np.log(x.n[x.members]) / np.log(100 / PERCENT)).astype(np.int64) + 1
            least = np.full((len(x.lengths) + 1) * 128, 127, np.int64)
            np.minimum.at(least, lists * 128 + size, x.multiple[x.members])
            lowest = np.minimum.reduce([least[lists * 128 + size + d] for d in (-1, 0, 1)])
            code = x.members * len(x.doc) + hub
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            a, b = code[first] // len(x.doc), code[first] % len(x.doc)
            names = bytetext.mix(np.arange(len(x.lengths), dtype=np.uint64) + (np.uint64(row["bucket"]) << np.uint64(32))).astype(np.uint32)
            bounds = np.append(first, len(code))
            tokens = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(names[lists[order]].tobytes())])
            yield pa.RecordBatch.from_arrays([
                pa.array(x.doc[a]), pa.array(x.doc[b]), pa.array(x.n[a].astype(np.int32)), pa.array(x.multiple[a].astype(np.int32)),
                pa.array(np.minimum(x.multiple[a], x.multiple[b]).astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)),
                pa.array(x.possible(a, b)), pa.array(x.classes[a] == x.classes[b]), pa.array(np.minimum.reduceat(lowest[order], first).astype(np.int32)), tokens,
            ], ["a", "hub", "n", "multiple", "needed", "shared", "possible", "same", "lowest", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar: the overlap is counted on whole sets."""
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        for chunk in bytetext.chunks(left):
            for part in bytetext.chunks(right.slice(chunk.first, chunk.last - chunk.first)):
                lo, hi = chunk.first + part.first, chunk.first + part.last
                one = next(iter(bytetext.chunks(left.slice(lo, hi - lo), 1 << 62)))
                (p, x), (q, y) = shingle_sets(one), shingle_sets(part)
                row = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(p)), np.repeat(np.arange(hi - lo), np.diff(q))])
                h = np.concatenate([x, y])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=hi - lo)
                union = np.diff(p) + np.diff(q) - both
                linked = np.flatnonzero((both > 0) & (100 * both >= PERCENT * union))
                yield pa.RecordBatch.from_arrays([a.slice(lo, hi - lo).take(pa.array(linked)), b.slice(lo, hi - lo).take(pa.array(linked))], ["a", "b"])


#: Documents on a side of a tile of texts and of one of tokens; tokens that are multiplied at a time.
TILE, TOKEN_TILE, TILE_SHINGLES = 256, 512, 1 << 13
#: Documents whose texts are dealt to tiles at a time, as a share of all rows.
BATCH_SHARE = 0.1


def _forest(doc: list, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (of the links a-b) that join the same documents: fewer than documents."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(doc[x]), find(doc[y])
        if p != q:
            root[p] = q
            out.append((doc[x], doc[y]))
    return out


def _overlaps(owner: np.ndarray, hashes: np.ndarray, who: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Number of common hashes of each left row (``side`` true) with each right one; ``who`` says which rows are one document."""
    number = np.cumsum(side) - 1
    number[~side] = np.cumsum(~side)[~side] - 1
    shared = np.zeros((int(side.sum()), int((~side).sum())), np.float32)
    if not len(hashes):
        return shared
    # a hash of one document only is shared with none; a document may stand on both sides
    order = np.lexsort((who[owner], hashes))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    length = np.diff(np.append(first, len(hashes)))
    several = who[owner[first]] != who[owner[first + length - 1]]
    keep = np.repeat(several, length)
    owner, token = owner[keep], np.repeat(np.cumsum(several) - 1, length)[keep]
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, TILE_SHINGLES):
        lo, hi = np.searchsorted(token, [first, first + TILE_SHINGLES])
        own, at = owner[lo:hi], token[lo:hi] - first
        sides = []
        for which, n in ((True, shared.shape[0]), (False, shared.shape[1])):
            m = np.zeros((n, int(at[-1]) + 1), np.float32)
            mine = side[own] == which
            m[number[own[mine]], at[mine]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    return shared


def _column(rows: list[dict], name: str) -> np.ndarray:
    return np.array([r[name] for r in rows])


def _linked(rows: list[dict]) -> pa.RecordBatch:
    """Links between the documents on the two sides of a tile."""
    found, sizes = [], []
    for chunk in bytetext.chunks(pa.array([r["text"] for r in rows], pa.string())):
        bounds, hashes = shingle_sets(chunk)
        found.append(hashes)
        sizes.append(np.diff(bounds))
    sizes, side, doc = np.concatenate(sizes), _column(rows, "left"), _column(rows, "doc_id")
    shared = _overlaps(np.repeat(np.arange(len(rows)), sizes), np.concatenate(found), np.unique(doc, return_inverse=True)[1], side)
    union = sizes[side][:, None] + sizes[~side][None, :] - shared
    a, b = np.nonzero((shared > 0) & (100 * shared >= PERCENT * union))
    links = _forest(doc.tolist(), np.flatnonzero(side)[a], np.flatnonzero(~side)[b])
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _likely(rows: list[dict]) -> pa.RecordBatch:
    """Documents of a tile that may be similar to one of the other side: left ones to documents of smaller ids.

    A document has ``due`` tokens with the hubs it takes part for, ``own`` of
    them with this one and ``missed`` with the hubs left out.
    """
    side, doc, component = _column(rows, "left"), _column(rows, "doc_id"), _column(rows, "component")
    least, most, multiple = (_column(rows, name).astype(np.int64) for name in ("n", "most", "multiple"))
    sets = [np.unique(np.frombuffer(b"".join(r["tokens"]), np.uint32)) for r in rows]
    shared = _overlaps(np.repeat(np.arange(len(rows)), [len(x) for x in sets]), np.concatenate(sets), np.unique(doc, return_inverse=True)[1], side)
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    pair = lambda x: (x[left][:, None], x[right][None, :])
    (n, m), (p, q) = pair(least), pair(multiple)
    overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
    # of the two prefixes the one that ends first lacks at most the rest of its set
    required = overlap - np.maximum(-(-PERCENT * n // 100) - p, -(-PERCENT * m // 100) - q)
    due, own, missed = (_column([rows[k] for k in left], name).astype(np.float64)[:, None] for name in ("due", "own", "missed"))
    passes = (shared * due >= (required - missed) * own) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
    # rows of one doc_id with sets of several sizes are not filtered
    several = least != most
    passes |= np.logical_or(*pair(several))
    (x, y), (u, v) = pair(doc), pair(component)
    a, b = np.nonzero((shared > 0) & passes & (x > y) & (u != v))
    keep = np.unique(np.concatenate([left[a], right[b]]))
    hub, open_ = _column(rows, "hub"), _column(rows, "open")
    return pa.RecordBatch.from_arrays([pa.array(hub[keep], pa.int64()), pa.array(doc[keep], pa.int64()), pa.array(open_[keep], pa.bool_()), pa.array(side[keep], pa.bool_())], ["hub", "doc_id", "open", "kept"])


def _by_tile(decide, rows_at_a_time: int):
    """decide(rows) for the rows of each tile, which stand together."""
    key = lambda r: (r["hub"], r["kind"], r["i"], r["j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_a_time):
                for row in batch.slice(start, rows_at_a_time).to_pylist():
                    if held and key(held[0]) != key(row):
                        yield decide(held)
                        held = []
                    held.append(row)
        if held:
            yield decide(held)

    return run


def _deal(members: DataFrame, payload: list[str], tile: int, width: int, docs: DataFrame | None = None) -> DataFrame:
    """Rows (hub, kind, i, j, doc_id, left, payload) of tiles, each of which stands together.

    ``members`` (hub, doc_id, open, kept): open ones are not in the hub's
    component, and a pair needs one that is open and one that is kept.  So kept
    open documents are compared with all (kind 0), other kept ones with the
    open ones (kind 1).
    """
    kinds = F.filter(F.array(
        F.when(F.col("open") & F.col("kept"), F.struct(F.lit(0).alias("kind"), F.lit(True).alias("left"))), F.struct(F.lit(0).alias("kind"), F.lit(False).alias("left")),
        F.when(~F.col("open") & F.col("kept"), F.struct(F.lit(1).alias("kind"), F.lit(True).alias("left"))), F.when(F.col("open"), F.struct(F.lit(1).alias("kind"), F.lit(False).alias("left")))), lambda x: x.isNotNull())
    sides = members.withColumn("x", F.explode(kinds)).select("hub", "doc_id", "x.kind", "x.left", *(c for c in payload if c in members.columns))
    blocks = sides.groupBy("hub", "kind").agg(
        F.ceil(F.sum(F.when(F.col("left"), 1).otherwise(0)) / tile).cast("int").alias("rows"), F.ceil(F.sum(F.when(F.col("left"), 0).otherwise(1)) / tile).cast("int").alias("columns"))
    sides = sides.join(blocks.filter("rows > 0 and columns > 0"), ["hub", "kind"])
    if docs is not None:
        sides = sides.join(docs, "doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.when(F.col("left"), F.col("rows")).otherwise(F.col("columns"))).cast("int")
    dealt = sides.select("hub", "kind", "doc_id", "left", *payload, place.alias("at"), F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("columns")).otherwise(F.col("rows")) - 1)).alias("other"))
    dealt = dealt.select("hub", "kind", "doc_id", "left", *payload, F.when(F.col("left"), F.col("at")).otherwise(F.col("other")).alias("i"), F.when(F.col("left"), F.col("other")).otherwise(F.col("at")).alias("j"))
    return dealt.repartition(width, "hub", "kind", "i", "j").sortWithinPartitions("hub", "kind", "i", "j")


def tiled_links(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Links (a, b) among the documents of each hub's lists."""
    dealt = _deal(members, ["text"], TILE, width, docs.select("doc_id", "text"))
    return dealt.mapInArrow(bytetext.lean(_by_tile(_linked, TILE)), "a bigint, b bigint").filter("a <> b").distinct()


def likely_members(members: DataFrame, width: int) -> DataFrame:
    """Those of ``members`` that may have a partner, with kept only if a pair needs it."""
    payload = ["open", "component", "n", "most", "multiple", "due", "own", "missed", "tokens"]
    dealt = _deal(members, payload, TOKEN_TILE, width)
    found = dealt.mapInArrow(bytetext.lean(_by_tile(_likely, TOKEN_TILE)), "hub bigint, doc_id bigint, open boolean, kept boolean")
    return found.groupBy("hub", "doc_id").agg(F.max("open").alias("open"), F.max("kept").alias("kept"))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar."""
    texts = docs.select("doc_id", "text")
    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(bytetext.lean(_verify), "a bigint, b bigint").distinct()


def _due(stars: DataFrame, found: DataFrame) -> DataFrame:
    """(hub, doc_id, open, kept, component, due, own, missed) of the documents of each hub's lists but the hub itself."""
    shared = stars.filter("a <> hub").groupBy("a", "hub").agg(F.sum("shared").alias("own"), F.min("lowest").alias("lowest"), F.min("same").alias("same"))
    whole = Window.partitionBy("a")
    kept = F.sum("own").over(whole.orderBy("own", "hub")) >= F.min("lowest").over(whole)
    part = lambda name, taken: F.sum(F.when(F.col("kept") == taken, F.col("own")).otherwise(0)).over(whole).alias(name)
    shared = shared.select("a", "hub", "own", "same", kept.alias("kept")).select("*", part("due", True), part("missed", False))
    of = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"{name}_component"))
    component = F.coalesce("a_component", "a")
    apart = ~F.col("same") & (component != F.coalesce("hub_component", "hub"))
    return shared.join(of("a"), "a", "left").join(of("hub"), "hub", "left").select(
        "hub", F.col("a").alias("doc_id"), apart.alias("open"), "kept", component.alias("component"), "due", "own", "missed")


def _open_members(stars: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(hub, doc_id, open, kept): documents that may be similar to one of another component; a stored table."""
    spark = stars.sparkSession
    members, path = scratch.stored(_due(stars, found), "members")
    # a hub matters if one of its documents is open and one is kept
    hubs = members.groupBy("hub").agg(F.max("open").alias("open"), F.max("kept").alias("kept")).filter("open and kept").select("hub")
    zero = F.lit(0).cast("bigint")
    own = members.unionByName(
        hubs.join(found, hubs["hub"] == found["id"], "left").select(
            "hub", F.col("hub").alias("doc_id"), F.lit(False).alias("open"), F.lit(False).alias("kept"), F.coalesce("component", "hub").alias("component"), zero.alias("due"), zero.alias("own"), zero.alias("missed")))
    tokens = stars.join(hubs, "hub", "left_semi").groupBy("hub", F.col("a").alias("doc_id")).agg(
        F.min("n").alias("n"), F.max("n").alias("most"), F.min("multiple").alias("multiple"), F.collect_list("tokens").alias("tokens"))
    likely = scratch.materialise(likely_members(own.join(tokens, ["hub", "doc_id"]), width), "likely")
    scratch.remove(spark, path)
    return likely


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; a stored table."""
    spark = docs.sparkSession
    width = scratch.shuffle_width(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base, survey = scratch.stored(docs.mapInArrow(bytetext.lean(_survey), "doc_id bigint, n bigint, h1 bigint, h2 bigint, cell int"), "survey")
    rows = base.filter("cell is null")
    named = docs.filter(F.col("doc_id").isNotNull())
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2")
    copies = rows.filter("n > 0").join(classes.agg(F.min("doc_id").alias("b"), F.count("*").alias("k")).filter("k > 1"), ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), "b")

    cells = np.zeros(SKETCH)
    for r in base.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # SKETCH rows at most
        cells[r.cell] = r.n
    # how often a shingle of the cell occurs beyond what chance puts there
    usual = float(np.median(cells))
    excess = np.maximum(1.0, cells - usual - 4 * np.sqrt(usual)).astype(np.float32)
    held = spark.sparkContext.broadcast(excess)
    lists, path = scratch.stored(
        named.mapInArrow(bytetext.lean(_poster(held, 4 * width)), POSTINGS_SCHEMA).repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(bytetext.lean(_by_bucket), LISTS_SCHEMA), "lists")
    held.destroy()
    stars, beside = scratch.stored(lists.mapInArrow(bytetext.lean(_stars), STARS_SCHEMA), "stars")
    scratch.remove(spark, path)
    candidates = (
        stars.filter("possible and not same and a <> hub").groupBy("a", "hub").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"))
        .filter("shared >= needed").groupBy("a").agg(F.max(F.struct("shared", (-F.col("hub")).alias("less"))).alias("best")).select("a", (-F.col("best.less")).alias("b"))
    )
    links, path = scratch.stored(verified(named, candidates), "links")
    found, joined = components.stored_components(copies.unionByName(links))
    scratch.remove(spark, path)

    # what a list still may link: documents that are not yet with its first one
    own = _open_members(stars, found, width)
    scratch.remove(spark, beside)
    held_rows = own.count()
    if held_rows:
        texts, path = scratch.stored(named.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
        # a document may be compared under several hubs: so many at a time that their texts take less room than the corpus
        batches = 1 + int(held_rows / (BATCH_SHARE * rows.count()))
        edges, paths = found.select(F.col("id").alias("a"), F.col("component").alias("b")), [path, joined]
        for k in range(batches):
            part, path = scratch.stored(tiled_links(texts, own.filter(F.pmod(F.xxhash64("hub"), F.lit(batches)) == k), width), "links")
            edges, paths = edges.unionByName(part), [*paths, path]
        found, joined = components.stored_components(edges)
        for path in paths:
            scratch.remove(spark, path)
    result = scratch.materialise(rows.join(found, rows["doc_id"] == found["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "components")
    for path in (survey, joined):
        scratch.remove(spark, path)
    return result
