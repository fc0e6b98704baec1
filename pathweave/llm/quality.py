"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are counted with array operations in Arrow
batches.  Trees are grown on the driver from a bounded sample of labelled rows,
then flattened into arrays, and executors walk all documents of a batch through
a tree together.  Only the text enters a score.

Defined cases: a null text is empty and has a score too; null labels and null
doc_ids are not learnt from, of several labels of a document the greatest
holds; without labels every score is 1; repeated rows are scored each; a very
long text is a chunk of its own and taken whole.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathweave.llm import bytetext

#: Labelled documents that training uses at most: those of least hashed doc_id.
TRAIN_ROWS = 20_000
HELD_OUT = 2
ACCEPT = 0.7
SHINGLE = 3

_ALONE = b" \n!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "lead": range(192, 256), "follow": range(128, 192)}


@cache
def _classes() -> tuple[np.ndarray, int]:
    table = np.zeros(256, np.int64)
    for k, b in enumerate(_ALONE):
        table[b] = k + 1
    for k, group in enumerate(_GROUPS.values()):
        table[list(group)] = len(_ALONE) + 1 + k
    return table, len(_ALONE) + 1 + len(_GROUPS)


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: items, distinct items, the greatest count of one item."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(d)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[first], runs)
    return total, np.bincount(d[first], minlength=n), most


def statistics(chunk: bytetext.Chunk) -> np.ndarray:
    """A row of statistics for each text of a chunk."""
    n, data, offsets = chunk.last - chunk.first, chunk.data, chunk.offsets
    lengths = np.diff(offsets)
    table, n_classes = _classes()
    doc = np.repeat(np.arange(n), lengths)
    share = np.bincount(doc * n_classes + table[data], minlength=n * n_classes).reshape(n, n_classes)
    per = lambda a, b: a / np.maximum(b, 1)
    columns = [np.log1p(lengths), *per(share, lengths[:, None]).T]

    w = bytetext.words(chunk, "blank")
    size = w.end - w.start
    count, distinct, most = _repeats(w.doc, w.hash, n)
    total = np.bincount(w.doc, size, n)
    mean = per(total, count)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, size)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    odd = np.concatenate([[0], np.cumsum((data > 32) & (data < 127) & (table[data] <= len(_ALONE)) & (table[data] > 0))])
    capitals = upper[w.end] - upper[w.start]
    marks = odd[w.end] - odd[w.start]
    initial = data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    final = data[w.end - 1] if len(w.start) else np.zeros(0, np.uint8)
    words_with = lambda mask: per(np.bincount(w.doc, mask, n), count)
    columns += [
        np.log1p(count), mean, np.sqrt(np.maximum(per(np.bincount(w.doc, size.astype(float) ** 2, n), count) - mean**2, 0)), np.log1p(longest),
        per(distinct, count), per(most, count), words_with((capitals == size) & (size > 1)), words_with((initial >= 65) & (initial <= 90)),
        words_with(marks > 0), words_with(marks >= 3), words_with(marks == size), words_with(size <= 2), words_with(size >= 15), words_with(final == 46),
    ]
    if len(w.hash) >= SHINGLE:
        h = sum((w.hash[i : len(w.hash) - SHINGLE + 1 + i] * np.uint64(2 * i + 3) for i in range(1, SHINGLE)), w.hash[: len(w.hash) - SHINGLE + 1])
        inside = w.doc[: len(h)] == w.doc[SHINGLE - 1 :]
        grams = _repeats(w.doc[: len(h)][inside], h[inside], n)
    else:
        grams = (np.zeros(n),) * 3
    columns += [per(grams[1], grams[0]), per(grams[2], grams[0])]

    feeds = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][lengths > 0], feeds + 1, offsets[-1:]]))
    start, end = start[:-1], start[1:]
    prefix = bytetext.prefix_hashes(bytetext.BYTE_VALUES[data])
    owner = np.searchsorted(offsets, start, "right") - 1
    lines, different, often = _repeats(owner, bytetext.span_hashes(prefix, start, end), n)
    columns += [np.log1p(lines), per(different, lines), per(often, lines), np.log1p(per(lengths, lines)), per(np.bincount(owner, (end - start) < 30, n), lines)]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Trees in flat arrays: children of node i are left[i] and left[i] + 1; a leaf is its own child."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)
    roots: list = field(default_factory=list)
    bias: float = 20.0
    depth: int = 0

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int32), ("cut", np.float32), ("left", np.int32), ("value", np.float64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                child = self.left[node]
                node = np.where(child == node, node, child + (x[rows, self.feature[node]] > self.cut[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, least: int = 10, smooth: float = 1.0) -> Trees:
    """Boost the logistic loss with trees grown level by level on binned values."""
    model = Trees(depth=depth)
    n, m = x.shape
    if not n or y.min() == y.max():
        model.bias = 20.0 if not n or y[0] else -20.0
        return model.freeze()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * bins
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        root = len(model.left)
        model.roots.append(root)
        node = np.full(n, root)

        def add(rows, gradient=gradient, hessian=hessian):
            model.feature.append(0)
            model.cut.append(0)
            model.left.append(len(model.left))
            model.value.append(rate * gradient[rows].sum() / (hessian[rows].sum() + smooth))
            return len(model.left) - 1

        level = [(add(np.arange(n)), np.arange(n))]
        for _ in range(depth):
            below = []
            for at, rows in level:
                if len(rows) < 2 * least:
                    continue
                cells = flat[rows].ravel()
                fold = lambda v: np.bincount(cells, np.repeat(v, m), m * bins).reshape(m, bins).cumsum(axis=1)  # noqa: B023, E731
                g, h, c = fold(gradient[rows]), fold(hessian[rows]), fold(np.ones(len(rows)))
                gain = g**2 / (h + smooth) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + smooth) - g[:, -1:] ** 2 / (h[:, -1:] + smooth)
                gain[(c < least) | (c[:, -1:] - c < least)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6:
                    continue
                right = binned[rows, j] > b
                model.feature[at], model.cut[at] = int(j), float(cuts[j][b])
                first = add(rows[~right])
                add(rows[right])
                model.left[at], model.value[at] = first, 0.0
                node[rows] = first + right
                below += [(first, rows[~right]), (first + 1, rows[right])]
            level = below
        margin += np.array(model.value)[node]
    return model.freeze()


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bytetext.chunks(batch.column(1)):
            x = statistics(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(x)), pa.array(list(x), pa.list_(pa.float32()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Learn ``target`` from at most ``rows`` labelled documents outside the held-out fold."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (remainder() != HELD_OUT))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # the limit above bounds what is broadcast, and with it the rows collected
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(bytetext.lean(_rows_of), "label int, x array<float>").toPandas()
    if not len(found):
        return Trees().freeze()
    order = np.lexsort((*np.stack(found["x"]).T, found["label"]))  # whichever order the rows came in
    return fit(np.stack(found["x"])[order], found["label"].to_numpy(np.float64)[order])


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.schema.names[:-1]
            for chunk in bytetext.chunks(batch.column(len(kept))):
                score = held.value.score(statistics(chunk))
                part = batch.slice(chunk.first, len(score))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*kept, "score"])

    return run


def score(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (none of them text) and ``score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return docs.select(*keep, F.col("text")).mapInArrow(bytetext.lean(_scorer(held)), schema)


def _chooser(held, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bytetext.chunks(batch.column(batch.schema.names.index("text"))):
                good = held.value.score(statistics(chunk)) >= least
                yield batch.slice(chunk.first, len(good)).filter(pa.array(good))

    return run


def accepted(docs: DataFrame, model: Trees, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(bytetext.lean(_chooser(held, least)), docs.schema)
