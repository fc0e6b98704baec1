"""Whole-text byte arrays: words and their hashes for many documents at once.

Texts of an Arrow batch are handled as one byte array, cut into chunks of
bounded size, so that a batch of long documents never fills a worker.  Words
are found with masks, and hashed through prefix sums of ``value * BASE**i``
modulo 2**64, which give the hash of any span in constant time; long words are
hashed by blake2b, as such sums of long strings can be made to agree.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20
#: Sums modulo 2**64 of strings this long may agree by construction (Thue-Morse strings from 1,024 bytes on).
LONG = 256
#: Bytes of short strings whose prefix sums are held at a time.
BLOCK_BYTES = 1 << 18


def lean(run):
    """``run`` for mapInArrow, after which a worker gives the memory that it no longer uses back to the system.

    Workers wait for later tasks beside the JVM; what they held at most would
    else stay theirs.
    """
    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return kept_small


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes (a finaliser with two multiplications)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A random odd value for each byte, the same in every process.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + LONG + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, with a zero in front."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each data[start:end], which are in order and apart; of those of LONG bytes or more a cryptographic one."""
    out, i = np.empty(len(start), np.uint64), 0
    stop = np.minimum(end, start + LONG)
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(start, low + BLOCK_BYTES))
        prefix = prefix_hashes(BYTE_VALUES[data[low : stop[j - 1]]])
        out[i:j] = mix(span_hashes(prefix, start[i:j] - low, stop[i:j] - low))
        i = j
    for i in np.flatnonzero(end - start >= LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes, and the offsets of each text."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into runs of rows of about ``limit`` bytes; a longer text is a run of its own. Null is empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


@cache
def word_class(pattern: str) -> np.ndarray:
    """For each byte, whether it belongs to a word. Both classes take every byte of a character beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    if pattern == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
        inside[0x30:0x3A] = inside[0x61:0x7B] = True
    else:  # [^\x20\x09-\x0D]
        inside[:128] = True
        inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


@cache
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(chunk: Chunk, pattern: str) -> Words:
    """Words of A-Z-lowered texts, in order; none crosses from one text to the next."""
    data = lower_table()[chunk.data]
    inside = word_class(pattern)[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    before[edges] = after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(chunk.offsets, start, "right") - 1
    return Words(start, end, doc, string_hashes(data, start, end))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pack(array: np.ndarray) -> bytes:
    """Compressed bytes of an array; byte planes are kept apart, which suits sorted numbers."""
    raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes() if len(array) else b""
    return len(array).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(blob[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


def pack_sorted(array: np.ndarray) -> bytes:
    """As pack(), through the differences of neighbours."""
    return pack(np.diff(array, prepend=array.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)
