"""Order-MinHash fingerprints, by built-in expressions only.

A text's elements are its word k-mers, each numbered by occurrence, so that a
repeated k-mer counts as often as it stands there.  Elements are hashed once
and dealt to ``BUCKETS`` buckets by their leading bits; in each bucket the two
of least hash are kept, put back into text order and hashed as a tuple.  A
tuple survives an edit only if both elements and their order do, which makes
the share of equal tuples fall with the edit distance and not only with the
overlap of the texts.

Defined cases: a null text is empty; an empty text has one element; a text of
fewer than ``K`` words has one k-mer.  Positions count modulo 2**24.  Equal
texts have equal fingerprints; rows with equal doc_id are ordered by text.
Extra columns are not read.  A null doc_id stands below all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import scratch
from pathweave.llm.expressions import let

K = 3
BUCKETS = 64
_BITS = 6
_POSITION = 24
_LOW = (1 << _POSITION) - 1
#: Most ranges into which documents are dealt for finding neighbours.
MAX_RANGES = 4096


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - _BITS)


def _element(x: Column) -> Column:
    return F.shiftrightunsigned(x, _POSITION)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW).cast("bigint"))


def _packed(hash_: Column, position: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_LOW).cast("bigint")).bitwiseOR(position)


def _kmers(words: Column) -> Column:
    """Sorted (k-mer hash, position) numbers."""
    last = F.greatest(F.size(words) - K, F.lit(0))
    return F.sort_array(F.transform(
        F.sequence(F.lit(0), last),
        lambda i: _packed(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), _position(i.cast("bigint")))))


def _numbered(kmers: Column) -> Column:
    """Sorted (hash of k-mer and occurrence, position) numbers."""
    n = F.size(kmers)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (_element(F.get(kmers, i)) != _element(F.get(kmers, i - 1))))
    return let(starts, lambda b: F.sort_array(F.flatten(F.transform(b, lambda first, run: F.transform(
        F.slice(kmers, first + 1, F.coalesce(F.get(b, run + 1), n) - first),
        lambda x, occurrence: _packed(F.xxhash64(_element(x), occurrence), _position(x)))))))


def _tuples(elements: Column) -> Column:
    """Two least elements of each bucket, in text order, as one number led by the bucket."""
    least = F.filter(elements, lambda x, i: (i < 2) | (_bucket(F.get(elements, i - 2)) != _bucket(x)))

    def of(kept: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            after, before = F.get(kept, i + 1), F.get(kept, i - 1)
            same = F.coalesce(_bucket(after) == _bucket(x), F.lit(False))
            pair = F.when(~same, F.xxhash64(_element(x))).when(
                _position(x) <= _position(after), F.xxhash64(_element(x), _element(after))
            ).otherwise(F.xxhash64(_element(after), _element(x)))
            number = F.shiftleft(_bucket(x), 64 - _BITS).bitwiseOR(F.shiftrightunsigned(pair, _BITS))
            return F.when(F.coalesce(_bucket(before) == _bucket(x), F.lit(False)), F.lit(None)).otherwise(number)

        return F.array_compact(F.transform(kept, entry))

    return let(least, of)


def fingerprint(text: Column) -> Column:
    """array<bigint>: a number for each bucket that has elements."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+")
    return let(words, lambda w: let(_kmers(w), lambda s: let(_numbered(s), _tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples, of the buckets that either has."""
    either = F.size(F.array_union(F.transform(a, _bucket), F.transform(b, _bucket)))
    return F.size(F.array_intersect(a, b)) / either.cast("double")


def as_string(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last third of code points replaced by the first as many of ``other``."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def with_next(rows: DataFrame, columns: list[str], order: str = "doc_id", tie: str = "text") -> DataFrame:
    """Add next_<column> from the next row by descending ``order``; after the last row comes the first.

    Rows are dealt to ranges of ``order`` between approximate quantiles, which
    are values of the data.  So the first row of each range is known, and a
    copy of it closes the range above: no row sees more than its own range.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col(order), F.lit(-(1 << 63)))
    ranges = min(MAX_RANGES, scratch.shuffle_width(spark))
    found = rows.agg(
        F.percentile_approx(key, [(i + 1) / ranges for i in range(ranges)], 10 * ranges).alias("cuts"), F.max(key).alias("top")).first()
    cuts = sorted({*(found.cuts or []), *([] if found.top is None else [found.top])})
    bounds = F.lit(cuts).cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda v: v < key))
    above = F.when(own + 1 < len(cuts), own + 1).otherwise(0)
    copies = F.when(F.array_contains(bounds, key), F.array(
        F.struct(own.alias("range"), F.lit(False).alias("copy")), F.struct(above.alias("range"), F.lit(True).alias("copy")),
    )).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("copy"))))
    dealt = rows.select("*", key.alias("_key"), F.explode(copies).alias("_at"))
    window = Window.partitionBy("_at.range").orderBy("_at.copy", F.desc("_key"), F.asc(tie))
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).filter(~F.col("_at.copy")).drop("_key", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", fingerprint(F.col("text")).alias("tuples"))
    pairs = with_next(rows, ["text", "tuples"]).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "tuples", "next_tuples", edited(F.col("text"), F.col("next_text")).alias("edited"))
    pairs = pairs.select("*", fingerprint(F.col("edited")).alias("edited_tuples"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("tuples")).alias("fingerprint"), as_string(F.col("edited_tuples")).alias("edited_fingerprint"),
        likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"),
        likeness(F.col("tuples"), F.col("next_tuples")).alias("near_next"))
