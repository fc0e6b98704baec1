"""Vector code compression: product codebooks trained by Lloyd rounds with Elkan's bounds, in whole numbers.

A component x becomes floor(scale * x).  Vectors are cut into equal parts, and
each part position has a codebook of its own.  A pass over the vectors keeps,
beside each vector, the entry of every part, an upper bound of the distance to
it, and a lower bound of the distance to each entry of the codebook.  Between
passes the bounds move by as much as the entries did, and an entry is looked at
only where neither its lower bound nor half its distance from the part's own
entry is strictly above the upper bound.  What is left is compared by exact
squared distances, ties to the lower index, so codes equal those of a plain
Lloyd search.  Upper bounds are rounded up and lower bounds down, to one byte.

Passes are stored tables: a lost executor costs the running pass at most.  The
driver holds the codebooks only (entries times components), whose sums come from
one grouping with partial sums for each task.

Defined cases: rows whose vector is null, or holds null or non-finite
components, are left out, as are those that cannot be cut: vectors of no
components, of a number that ``parts`` does not divide, or of another number
than that of the first kept row.  Of fewer rows than entries the codebooks are
shorter.  Equal ids and repeated rows are separate rows; of equal ids, the
lesser vector is taken first for the codebooks; null ids come last.  Kept
columns may have any names.  An empty table gives no rows.  Components of 2**40
and more raise ValueError, as their squared distances are no longer numbers of
64 bits.  Very long vectors take smaller batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm import scratch
from pathweave.llm.bytetext import lean
from pathweave.llm.expressions import fresh

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers up to this are exact in doubles.
EXACT = 1 << 53
#: Magnitude of x from which squared distances need more than 64 bits.
LARGEST = 1 << 40
#: Steps of a lower bound, from zero to the greatest distance between two entries.
LEVELS = 63
#: Components handled at a time.
SLICE = 1 << 20


@dataclass
class Codes:
    """The coded rows (kept columns, code, error), and the final codebooks by part, entry and position."""

    rows: DataFrame
    books: list[list[list[int]]]
    code: str
    error: str

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def up(d: np.ndarray) -> np.ndarray:
    return d * (1 + 1e-12)


def down(d: np.ndarray) -> np.ndarray:
    return d * (1 - 1e-12)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _like(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole numbers in the type of ``c``."""
    return x if c.dtype == np.float64 else x.astype(np.int64).astype(object)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Books:
    """Codebooks of one round and what passes need of them: distances between entries, and how far each has moved."""

    def __init__(self, entries: list[list[list[int]]], before: Books | None = None):
        self.entries = entries
        self.n_parts, self.n, self.width = len(entries), len(entries[0]), len(entries[0][0])
        self.largest = max(abs(x) for book in entries for entry in book for x in entry)
        exact = np.array(entries, object)
        apart = down(_root(_squares(exact[:, :, None], exact[:, None])))
        self.half = apart / 2
        self.unit = max(float(apart.max()), 1.0) / LEVELS
        self.moved = up(_root(_squares(exact, np.array(before.entries, object)))) if before else np.zeros((self.n_parts, self.n))

    def typed(self, x: np.ndarray) -> np.ndarray:
        """The codebooks as doubles where all squared distances to ``x`` are exact in them, else as Python's whole numbers."""
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        return np.array(self.entries, np.float64 if self.width * (2 * most) ** 2 < EXACT else object)


@dataclass
class State:
    """Entries (n, parts), upper bounds (n, parts) and lower bounds (n, parts, entries) of n vectors."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def numbers(vectors: pa.Array, n_parts: int) -> np.ndarray:
    """floor(SCALE * x) as doubles: (n, parts, width)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) >= LARGEST:
        raise ValueError(f"components of {LARGEST} and more cannot be coded")
    return np.floor(flat * SCALE).reshape(len(vectors), n_parts, -1)


def first_pass(x: np.ndarray, books: Books) -> tuple[State, np.ndarray]:
    """Every distance to every entry. (state, squared distance of each part)"""
    n = len(x)
    state = State(np.zeros((n, books.n_parts), np.int64), np.zeros((n, books.n_parts)), np.zeros((n, books.n_parts, books.n)))
    c = books.typed(x)
    x, best = _like(x, c), np.zeros((n, books.n_parts), c.dtype)
    for s in range(books.n_parts):
        d = _squares(x[:, s, None], c[s])
        own = d.argmin(1) if n else np.zeros(0, np.int64)
        best[:, s] = d[np.arange(n), own]
        state.own[:, s], state.lower[:, s] = own, down(_root(d))
        state.upper[:, s] = up(_root(best[:, s]))
    return state, best


def next_pass(x: np.ndarray, books: Books, state: State) -> tuple[State, np.ndarray, int]:
    """The state after the entries have moved, the squared distances, and the number of distances computed beside those to own entries."""
    c, looked = books.typed(x), 0
    x, best = _like(x, c), np.zeros((len(x), books.n_parts), c.dtype)
    for s in range(books.n_parts):
        own, lower, half = state.own[:, s], state.lower[:, s], books.half[s]
        lower -= books.moved[s]
        upper = state.upper[:, s] + books.moved[s][own]
        best[:, s] = _squares(x[:, s], c[s][own])
        exact = up(_root(best[:, s]))
        rows = np.flatnonzero(((lower <= upper[:, None]) & (half[own] <= upper[:, None])).sum(1) > 1)
        at, mine = np.arange(len(rows)), own[rows]
        upper[rows] = exact[rows]
        open_ = (lower[rows] <= exact[rows, None]) & (half[mine] <= exact[rows, None])
        open_[at, mine] = False
        i, e = np.nonzero(open_)
        looked += len(i)
        d = _squares(x[rows[i], s], c[s][e])
        near = np.full((len(rows), books.n), np.inf, c.dtype)
        near[i, e], near[at, mine] = d, best[rows, s]
        lower[rows[i], e] = down(_root(d))
        lower[rows, mine] = down(_root(best[rows, s]))
        if len(rows):
            new = near.argmin(1)
            own[rows], best[rows, s] = new, near[at, new]
            upper[rows] = up(_root(best[rows, s]))
        state.upper[:, s] = upper
    return state, best, looked


def _packed(state: State, unit: float) -> tuple[list[bytes], list[bytes], list[bytes]]:
    own = state.own.astype(np.uint16)
    upper = np.nextafter(state.upper.astype(np.float32), np.float32(np.inf))
    lower = np.clip(down(state.lower / unit), 0, 255).astype(np.uint8)
    return [r.tobytes() for r in own], [r.tobytes() for r in upper], [r.tobytes() for r in lower]


def _unpacked(batch: pa.RecordBatch, books: Books, unit: float) -> State:
    n, shape = batch.num_rows, (batch.num_rows, books.n_parts)
    read = lambda name, dtype: np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype)
    return State(
        read("own", np.uint16).reshape(shape).astype(np.int64), read("upper", np.float32).reshape(shape).astype(np.float64),
        read("lower", np.uint8).reshape(n, books.n_parts, books.n).astype(np.float64) * unit)


def _slices(batches: Iterator[pa.RecordBatch], n_parts: int, n_entries: int) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE components or bounds."""
    for batch in batches:
        if batch.num_rows:
            width = max(1, len(batch.column("vector").flatten()) // batch.num_rows, n_parts * n_entries)
            step = max(1, SLICE // width)
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)


def _pass(rows: DataFrame, books: Books, unit: float | None, last: bool, keys: str) -> DataFrame:
    """One pass: the rows with their new state, or with codes and errors after the ``last``."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        for batch in _slices(batches, now.n_parts, now.n):
            x = numbers(batch.column("vector"), now.n_parts)
            state, best = first_pass(x, now) if unit is None else next_pass(x, now, _unpacked(batch, now, unit))[:2]
            if last:
                codes = [r.tobytes().hex() for r in state.own.astype(np.uint8)]
                out = [batch.column("key"), pa.array(codes, pa.string()), pa.array([int(sum(r)) for r in best.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["key", "code", "error"])
            else:
                out = [batch.column("key"), batch.column("vector"), *(pa.array(x, pa.binary()) for x in _packed(state, now.unit))]
                yield pa.RecordBatch.from_arrays(out, ["key", "vector", "own", "upper", "lower"])

    vector = rows.schema["vector"].dataType.simpleString()
    after = f"key {keys}, code string, error bigint" if last else f"key {keys}, vector {vector}, own binary, upper binary, lower binary"
    return rows.mapInArrow(lean(run), after)


def _sums(state: DataFrame, books: Books) -> dict[tuple[int, int, int], int]:
    """By (part, entry, position): the sum of its components; at position -1 their number. Of the size of the codebooks."""
    n_parts, n, width = books.n_parts, books.n, books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, n, width + 1), object)
        for batch in _slices(batches, n_parts, n):
            x = numbers(batch.column("vector"), n_parts)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint16).reshape(len(x), n_parts)
            small = len(x) * int(np.abs(x).max(initial=0)) < EXACT
            for s in range(n_parts):
                total[s, :, 0] += np.bincount(own[:, s], minlength=n).astype(object)
                if small:
                    for j in range(width):
                        total[s, :, j + 1] += np.bincount(own[:, s], x[:, s, j], n).astype(np.int64).astype(object)
                else:
                    exact = np.array([int(y) for y in x[:, s].ravel()], object).reshape(len(x), width)
                    np.add.at(total[s, :, 1:], own[:, s], exact)
        part, entry = np.nonzero(total[:, :, 0])
        for i in range(0, len(part), 256):
            p, e = np.repeat(part[i : i + 256], width + 1), np.repeat(entry[i : i + 256], width + 1)
            at = np.tile(np.arange(-1, width), len(p) // (width + 1))
            sums = pa.array([str(total[a, b, j + 1]) for a, b, j in zip(p, e, at, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), sums], ["part", "entry", "at", "sum"])

    rows = state.select("vector", "own").mapInArrow(lean(run), "part int, entry int, at int, sum string")
    sums = rows.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    return {(r.part, r.entry, r["at"]): int(r["sum"]) for r in sums.collect()}


def _moved(books: Books, sums: dict[tuple[int, int, int], int]) -> Books:
    entries = [
        [[sums[s, e, j] // sums[s, e, -1] for j in range(books.width)] if (s, e, -1) in sums else entry for e, entry in enumerate(book)]
        for s, book in enumerate(books.entries)]
    return Books(entries, books)


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Code every vector after ``rounds`` of Lloyd's method that start from the vectors of least id."""
    spark = vectors.sparkSession
    names = [id_column, *keep]
    code, error = fresh("code", names), fresh("error", names)
    kind = vectors.schema[column].dataType.simpleString()
    v = F.col(f"`{column}`") if kind == "array<float>" else F.col(f"`{column}`").cast("array<double>")
    key = F.struct(*[F.col(f"`{c}`") for c in names])
    sound = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    rows = vectors.select(key.alias("key"), v.alias("vector")).filter(sound & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    keys = rows.schema["key"].dataType.simpleString()
    # of the size of a codebook; the first row fixes the number of components
    start = rows.orderBy(F.col("key").getField(id_column).asc_nulls_last(), "vector")
    width = start.select(F.size("vector").alias("n")).head(1)
    if not width:
        return Codes(spark.createDataFrame([], f"key {keys}, code string, error bigint").select("key.*", F.col("code").alias(code), F.col("error").alias(error)), [], code, error)
    rows = rows.filter(F.size("vector") == width[0].n)
    first = [r.vector for r in start.filter(F.size("vector") == width[0].n).select("vector").head(entries)]
    step = width[0].n // parts
    books = Books([[[math.floor(SCALE * x) for x in vector[s * step : (s + 1) * step]] for vector in first] for s in range(parts)])
    unit, path = None, None
    for _ in range(rounds):
        rows, made = scratch.stored(_pass(rows, books, unit, False, keys), "bounds")
        if path:
            scratch.remove(spark, path)
        path, unit = made, books.unit
        books = _moved(books, _sums(rows, books))
    coded, _ = scratch.stored(_pass(rows, books, unit, True, keys), "codes")
    if path:
        scratch.remove(spark, path)
    return Codes(coded.select("key.*", F.col("code").alias(code), F.col("error").alias(error)), books.entries, code, error)
