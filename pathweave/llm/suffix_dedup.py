"""Exact removal of repeated byte strings of ``length`` bytes or more.

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller doc_id.  A suffix array of the whole corpus cannot be
sorted in one place, so suffixes are taken at anchors: the least-hashed 16-gram
of each window of ``length`` bytes.  Equal windows have equal anchors, and each
window belongs to one anchor, which stands for a run of windows.

Round 1 deals anchors to buckets by their gram.  An anchor whose whole run of
windows (its context, compared by a 64-bit hash beside the gram's) also occurs
in a smaller document is settled.  Equal contexts within a group of documents
are sent once, so a passage that is very common costs a row a group.

Round 2 takes the few grams whose contexts differ, with the context's bytes.
The suffixes that begin at the anchors are sorted by mergesort; a comparison
finds the common extension by binary search on prefix polynomial hashes.  The
sorted order gives, for each distance of a window's start before the anchor,
the classes of equal windows; bytes are compared before a window is marked.

Defined cases: a null text is empty; a null doc_id is larger than any other;
rows with equal doc_id never remove from each other; repeated rows have equal
results; a text beyond 2 MB is taken in overlapping parts of 1 MB; an empty
table gives an empty one.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm import bytetext, scratch

LENGTH = 50
GRAM = 16
#: Bytes handled at a time; longer texts are taken in overlapping parts.
PART_BYTES = 1 << 20
#: Bytes whose anchors travel together: equal contexts among them are sent once.
GROUP_BYTES = 16 << 20
_LAST = (1 << 63) - 1


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, the first of equals."""
    at, best, have = np.arange(len(values), dtype=np.int32), values, 1
    while have < width:
        step = min(have, width - have)
        later = best[step:] < best[:-step]
        at = np.where(later, at[step:], at[:-step])
        best = np.minimum(best[step:], best[:-step])
        have += step
    return at


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` values from each place; gram is a power of two."""
    h, base, have = values, bytetext.BASE, 1
    while have < gram:
        h = h[:-have] * np.uint64(base) + h[have:]
        base, have = base * base % (1 << 64), 2 * have
    return bytetext.mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor place, first window, last window, gram hash, prefix hashes) of texts laid end to end."""
    none = np.zeros(0, np.int64)
    values = bytetext.BYTE_VALUES[data]
    prefix = bytetext.prefix_hashes(values)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), prefix
    grams = gram_hashes(values, GRAM)
    at = windows_min(grams, length - GRAM + 1)
    # windows that cross from one text to the next are none
    whole = np.ones(len(at), bool)
    for edge in offsets[1:-1]:
        whole[max(0, edge - length + 1) : edge] = False
    starts = np.flatnonzero(whole)
    own = at[starts]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else none
    last = np.append(first[1:], len(starts)) - 1
    place = own[first].astype(np.int64)
    return place, starts[first], starts[last], grams[place], prefix


def _parts(chunk: bytetext.Chunk, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the part in its text, bytes, offsets); each window is in one part."""
    if chunk.last - chunk.first > 1 or len(chunk.data) <= 2 * PART_BYTES:
        yield chunk.first, 0, chunk.data, chunk.offsets
        return
    for a in range(0, len(chunk.data), PART_BYTES):
        data = chunk.data[a : a + PART_BYTES + length - 1]
        yield chunk.first, a, data, np.array([0, len(data)])


_ROUND1 = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("versions", pa.binary()), ("gram", pa.binary()), ("context", pa.binary()), ("owner", pa.binary()), ("place", pa.binary())])
ROUND1_SCHEMA = "bucket int, docs binary, versions binary, gram binary, context binary, owner binary, place binary"
#: A run of windows is a number: its first place, then 16 bits that say how many follow.
_SPAN = 1 << 16
#: state 1: all windows of the run occur earlier; 2: its anchor's context goes to round 2.
STATE_SCHEMA = "doc bigint, version bigint, state int, places binary"


def _versions(chunk: bytetext.Chunk) -> np.ndarray:
    """A hash of each whole text, to tell rows of one doc_id apart."""
    raw = chunk.data.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.int64)


def _emit(group: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a group of documents, equal contexts once, dealt to buckets; the others' fates are the first one's or state 1."""
    docs, versions = np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group])
    gram, context, owner, place = (np.concatenate([g[k] for g in group]) for k in range(2, 6))
    order = np.lexsort((place, docs[owner], context, gram))
    gram, context, owner, place = gram[order], context[order], owner[order], place[order]
    same = np.r_[False, (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])] if len(gram) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram)))) if len(gram) else np.zeros(0, np.int64)
    settled = same & (docs[owner] > docs[owner[lead]])
    # a negative bucket carries what is settled here
    bucket = np.where(settled, -1 - int(docs[0] % buckets), (gram % np.uint64(buckets)).astype(np.int64))
    keep = settled | ~same | (docs[owner] == docs[owner[lead]])
    order = np.flatnonzero(keep)[np.argsort(bucket[keep], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True) if len(order) else ():
        own = order[a:b]
        used, local = np.unique(owner[own], return_inverse=True)
        here = bucket[own[0]] < 0
        yield pa.RecordBatch.from_pylist([{
            "bucket": int(bucket[own[0]]), "docs": bytetext.pack(docs[used]), "versions": bytetext.pack(versions[used]),
            "gram": b"" if here else bytetext.pack_sorted(gram[own] // np.uint64(buckets)), "context": b"" if here else bytetext.pack(context[own]),
            "owner": bytetext.pack(local.astype(np.int32)), "place": bytetext.pack(place[own]),
        }], _ROUND1)


def _round1(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, count = [], 0, 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in bytetext.chunks(batch.column(1), PART_BYTES):
                version = _versions(chunk)
                for first, shift, data, offsets in _parts(chunk, length):
                    place, a, b, gram, prefix = anchors(data, offsets, length)
                    row = np.searchsorted(offsets, place, "right") - 1
                    # the context's extent before and after the anchor is part of it
                    context = bytetext.mix(bytetext.span_hashes(prefix, a, b + length) + ((place - a) * _SPAN + (b - a)).astype(np.uint64))
                    n = len(offsets) - 1
                    group.append((doc[first : first + n], version[first - chunk.first : first - chunk.first + n], gram, context, row + count, (a - offsets[row] + shift) * _SPAN + b - a))
                    count += n
                    size += len(data)
                    if size >= GROUP_BYTES:
                        yield from _emit(group, buckets)
                        group, size, count = [], 0, 0
        if group:
            yield from _emit(group, buckets)

    return run


def _by_document(doc: np.ndarray, version: np.ndarray, state: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((place, state, version, doc))
    doc, version, state, place = doc[order], version[order], state[order], place[order]
    change = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(version) != 0) | (np.diff(state) != 0), True]) if len(doc) else np.zeros(1, int)
    return pa.RecordBatch.from_arrays([
        pa.array(doc[change[:-1]], pa.int64()), pa.array(version[change[:-1]], pa.int64()), pa.array(state[change[:-1]].astype(np.int32)),
        pa.array([place[a:b].astype("<i8").tobytes() for a, b in zip(change[:-1], change[1:], strict=True)], pa.binary()),
    ], ["doc", "version", "state", "places"])


def _load(rows: list[dict]) -> tuple[np.ndarray, ...]:
    docs, versions, grams, contexts, places = [], [], [], [], []
    for r in rows:
        owner = bytetext.unpack(r["owner"], np.int32)
        docs.append(bytetext.unpack(r["docs"], np.int64)[owner])
        versions.append(bytetext.unpack(r["versions"], np.int64)[owner])
        places.append(bytetext.unpack(r["place"], np.int64))
        if r["gram"]:
            grams.append(bytetext.unpack_sorted(r["gram"], np.uint64))
            contexts.append(bytetext.unpack(r["context"], np.uint64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (docs, versions, grams, contexts, places))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some whole buckets, which stand together: decide about their anchors."""
    held: list[dict] = []

    def decide() -> Iterator[pa.RecordBatch]:
        doc, version, gram, context, place = _load(held)
        order = np.lexsort((doc, context, gram))
        doc, version, gram, context, place = (x[order] for x in (doc, version, gram, context, place))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, context[1:] != context[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        settled = doc > doc[first]
        gram_at = np.flatnonzero(new_gram)
        several = np.repeat(np.add.reduceat(new, gram_at) > 1, np.diff(np.append(gram_at, len(doc))))
        lowest = np.repeat(np.minimum.reduceat(doc, gram_at), np.diff(np.append(gram_at, len(doc))))
        highest = np.repeat(np.maximum.reduceat(np.where(settled, lowest, doc), gram_at), np.diff(np.append(gram_at, len(doc))))
        # one document shows each context; rows of that document with other versions show it too
        second = ~settled & several & (lowest < highest)
        keep = settled | second
        yield _by_document(doc[keep], version[keep], np.where(settled, 1, 2)[keep], place[keep])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                doc, version, _, _, place = _load([row])
                yield _by_document(doc, version, np.ones(len(doc), np.int64), place)
                continue
            if held and held[0]["bucket"] != row["bucket"]:
                yield from decide()
                held = []
            held.append(row)
    if held:
        yield from decide()


# ---------------------------------------------------------------- suffix sort


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to ``most``: binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        equal = bytetext.span_hashes(prefix, a, a + middle) == bytetext.span_hashes(prefix, b, b + middle)
        low, high = np.where(open_ & equal, middle, low), np.where(open_ & ~equal, middle - 1, high)


def compare(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Sign of the order of the suffixes at a and b; an end is less than any byte."""
    most = np.minimum(a_end - a, b_end - b)
    n = common(prefix, a, b, most)
    short = n == most
    at = np.where(short, 0, n)
    last = len(data) - 1
    bytes_ = data[np.minimum(a + at, last)].astype(np.int64) - data[np.minimum(b + at, last)]
    return np.sign(np.where(short, (a_end - a) - (b_end - b), bytes_))


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes data[start:end] within each group, by mergesort, all merges of a level at once.

    ``group`` is sorted; groups stay where they are.  An element's place in a
    merged run is its place in its own run and the number of smaller ones in
    the sister run, found by binary search; each comparison takes the common
    extension by hashes.
    """
    n = len(start)
    order = np.arange(n)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if group is not None and n else np.zeros(min(n, 1), np.int64)
    sizes = np.diff(np.append(edges, n))
    width = 1
    while (sizes > width).any():
        some = sizes > width
        own = bytetext.ragged(edges[some], sizes[some])
        base = np.repeat(edges[some], sizes[some])
        stop = base + np.repeat(sizes[some], sizes[some])
        index = own - base
        run = index // width
        left = run % 2 == 0
        sister = base + np.where(left, run + 1, run - 1) * width
        first = np.minimum(sister, stop)
        low, high = first.copy(), np.minimum(sister + width, stop)
        me = order[own]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            other, mine = order[middle], me[open_]
            sign = compare(data, prefix, start[other], end[other], start[mine], end[mine])
            # stable: of equals the left run's come first
            after = (sign < 0) | ((sign == 0) & ~left[open_])
            low[open_] = np.where(after, middle + 1, low[open_])
            high[open_] = np.where(after, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        order[base + run // 2 * 2 * width + index % width + (low - first)] = me
        width *= 2
    return order


_CONTEXT = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("place", pa.int64()), ("back", pa.int32()), ("ahead", pa.int32()), ("bytes", pa.binary())])
CONTEXT_SCHEMA = "gram bigint, doc bigint, version bigint, place bigint, back int, ahead int, bytes binary"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            wanted = batch.column(3)
            for chunk in bytetext.chunks(batch.column(2), PART_BYTES):
                for first, shift, data, offsets in _parts(chunk, length):
                    place, a, b, gram, _ = anchors(data, offsets, length)
                    row = np.searchsorted(offsets, place, "right") - 1
                    at, run_ = place - offsets[row] + shift, (a - offsets[row] + shift) * _SPAN + b - a
                    bounds = np.searchsorted(row, np.arange(len(offsets)))
                    found = []
                    for r in range(len(offsets) - 1):
                        mine = np.frombuffer(b"".join(wanted[first + r].as_py()), "<i8")
                        found.append(bounds[r] + np.flatnonzero(np.isin(run_[bounds[r] : bounds[r + 1]], mine)))
                    own = np.concatenate(found)
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(gram[own].view(np.int64)), pa.array(doc[first + row[own]]), pa.array(version[first + row[own]]), pa.array(at[own]),
                        pa.array((place - a)[own].astype(np.int32)), pa.array((b - place)[own].astype(np.int32)),
                        pa.array([raw[x:y] for x, y in zip(a[own], b[own] + length, strict=True)], pa.binary()),
                    ], schema=_CONTEXT)

    return run


def repeated_windows(gram: np.ndarray, doc: np.ndarray, back: np.ndarray, ahead: np.ndarray, texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, int]]:
    """(contexts, shift): the window that starts ``shift`` bytes from the anchor occurs in a smaller document."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    anchor = ends - sizes + back
    prefix = bytetext.prefix_hashes(bytetext.BYTE_VALUES[data])
    order = suffix_sort(data, prefix, anchor, ends, gram)
    a, b = anchor[order[:-1]], anchor[order[1:]]
    shared = np.r_[0, common(prefix, a, b, np.minimum(ends[order[:-1]] - a, ends[order[1:]] - b))]
    shared[np.r_[True, gram[1:] != gram[:-1]]] = 0
    for shift in range(-int(back.max()), int(ahead.max()) + 1):
        inside = (back[order] >= -shift) & (ahead[order] >= shift)
        if inside.sum() < 2:
            continue
        # contexts whose bytes from the anchor agree as far as this window reaches
        reach = np.cumsum(shared < length + shift)
        own, reach = order[inside], reach[inside]
        start = anchor[own] + shift
        head = bytetext.span_hashes(prefix, np.minimum(start, anchor[own]), anchor[own])
        by = np.lexsort((doc[own], head, reach))
        own, start, head, reach = own[by], start[by], head[by], reach[by]
        new = np.r_[True, (reach[1:] != reach[:-1]) | (head[1:] != head[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        again = np.flatnonzero(doc[own] > doc[own[first]])
        # the bytes decide
        windows = np.lib.stride_tricks.sliding_window_view(data, length)
        equal = (windows[start[again]] == windows[start[first[again]]]).all(axis=1)
        if equal.any():
            yield own[again[equal]], shift
        if not equal.all():  # hashes of different bytes agreed: compare each of the class by itself
            for k in again[~equal]:
                same = own[(reach == reach[k]) & (windows[start] == windows[start[k]]).all(axis=1)]
                if len(same) and doc[same].min() < doc[own[k]]:
                    yield own[k : k + 1], shift


def _compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def decide(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            gram, doc, version, place, back, ahead = (t.column(i).to_numpy() for i in range(6))
            # a window of the same document and place is no other one
            found = [(own, place[own] + shift) for own, shift in repeated_windows(gram, doc, back.astype(np.int64), ahead.astype(np.int64), t.column(6).to_pylist(), length)]
            if found:
                own, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                yield _by_document(doc[own], version[own], np.ones(len(own), np.int64), at * _SPAN)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # cut where the gram changes, so that the suffixes of a gram stay together
                grams = batch.column(0).to_numpy()[at:]
                if size >= PART_BYTES:
                    last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                    change = np.flatnonzero(grams != last)
                    if len(change):
                        stop = int(change[0])
                        if stop:
                            held.append(batch.slice(at, stop))
                        yield from decide(held)
                        held, size, at = [], 0, at + stop
                        continue
                step = min(batch.num_rows - at, 4096)
                held.append(batch.slice(at, step))
                size += 90 * step
                at += step
        if held:
            yield from decide(held)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, kept binary"


def _remove(length: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, marks = batch.column(0), batch.column(3)
            for chunk in bytetext.chunks(batch.column(2), PART_BYTES):
                gone = np.zeros(len(chunk.data) + 1, np.int32)
                for r, blobs in enumerate(marks.slice(chunk.first, chunk.last - chunk.first).to_pylist()):
                    if blobs:
                        runs = np.frombuffer(b"".join(blobs), "<i8")
                        at = runs // _SPAN + chunk.offsets[r]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + runs % _SPAN + length, -1)
                removed = np.cumsum(gone[:-1]) > 0
                out = []
                for r in range(chunk.last - chunk.first):
                    lo, hi = chunk.offsets[r], chunk.offsets[r + 1]
                    own = removed[lo:hi]
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
                    kept = chunk.data[lo:hi][~own].tobytes()
                    out.append({
                        "doc_id": doc[chunk.first + r].as_py(), "n_bytes": int(hi - lo), "n_removed": int(own.sum()), "n_spans": len(edge) // 2,
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": edge.tolist(), "kept": kept if with_kept else None,
                    })
                yield pa.RecordBatch.from_pylist(out, _RESULT)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bytetext.chunks(batch.column(1), PART_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, chunk.last - chunk.first), pa.array(_versions(chunk)), batch.column(1).slice(chunk.first, chunk.last - chunk.first)],
                ["doc", "version", "text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): spans as start, end, start, ...

    The anchors of a bucket, the texts of documents with open anchors, the
    contexts of a gram, and at the end the texts beside their marks are moved
    one after the other, each in a query of its own whose shuffle files go.
    """
    if not GRAM <= length < _SPAN:
        raise ValueError(f"strings of {GRAM} bytes at least and under {_SPAN}")
    spark = docs.sparkSession
    n = scratch.shuffle_width(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.mapInArrow(bytetext.lean(_keyed), "doc bigint, version bigint, text string")
    states, path = scratch.stored(
        rows.mapInArrow(bytetext.lean(_round1(n * 4, length)), ROUND1_SCHEMA).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(bytetext.lean(_settle), STATE_SCHEMA), "anchors")
    open_ = states.filter("state = 2").groupBy("doc", "version").agg(F.collect_list("places").alias("wanted"))
    contexts = keyed.join(open_, ["doc", "version"]).select("doc", "version", "text", "wanted").mapInArrow(bytetext.lean(_contexts(length)), CONTEXT_SCHEMA)
    sorted_, beside = scratch.stored(contexts.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(bytetext.lean(_compare(length)), STATE_SCHEMA), "sorted")
    marks = states.filter("state = 1").unionByName(sorted_).groupBy("doc", "version").agg(F.collect_list("places").alias("marks"))
    marks = scratch.materialise(marks, "marks")
    for done in (path, beside):
        scratch.remove(spark, done)
    done = keyed.join(marks, ["doc", "version"], "left").select("doc", "version", "text", "marks").mapInArrow(bytetext.lean(_remove(length, with_kept)), RESULT_SCHEMA)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
