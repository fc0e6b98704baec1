"""Removal of lines that repeat an earlier line, exactly or nearly: an exact set-similarity join in SQL functions.

A line's tokens are its hashed word 5-shingles, or the hash of all its words if
it has fewer than five, ordered by rarity: a table of fixed size counts all
shingles, those of cells fuller than chance makes them come last, then by hash.
Two lines match if the Jaccard similarity of their token sets is
``PERCENT``/100 or more.  Equal lines are one representative, its first
occurrence.  Representatives are joined on the tokens of their prefixes, under
the length and the positional filter, and pairs are verified on the whole sets.

A line goes if any earlier line matches it, earlier by (doc_id, line number),
judged on the input.  So that a group of near copies is not listed pair by
pair, each token's lines are first compared with the earliest of them only; a
line that this does not settle is then paired with the earlier lines of its
tokens that have as many tokens in lists of several lines as must be shared.

Only built-in expressions: no Python runs on executors.  Defined cases: lines
without a word are left alone and match nothing; a line of one to four words
matches the lines of the same words only; a null text has no line and stays
null; a null doc_id comes last; rows of equal doc_id and text have equal results
and do not remove from each other; rows of one doc_id with different texts are
ordered by a hash of the text; very long texts and lines are taken whole, a row
at a time.  Columns of the input are kept, whatever their names, and text
changes; where the input has a column n_lines or n_removed, the added column's
name gets an underscore.  An empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm import scratch
from pathweave.llm.expressions import fresh, let

SHINGLE = 5
PERCENT = 75
#: Cells of the table that counts shingles.
CELLS = 1 << 16
_TOKEN_BITS = 56


def normal(line: Column) -> Column:
    """Lower case, without blanks at the ends, one blank between words."""
    def single(x: Column) -> Column:
        odd = reduce(Column.__or__, [F.contains(x, F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")])
        # blanks are the only gaps left here; trimming other characters would take a list of all places of the line
        return F.trim(F.when(odd, F.regexp_replace(x, r"[\x09-\x0D\x20]+", " ")).otherwise(x))

    return let(F.lower(line), single)


def _words(lines: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of lines in normal form, their words w, and the number n of their shingles, repeated ones too."""
    words = lines.select(*columns, F.split("line", " ").alias("w"))
    return words.select(*columns, "w", F.greatest(F.size("w") - SHINGLE + 1, F.lit(1)).alias("n"))


def _exploded(words: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the token of each shingle; a line of fewer words than SHINGLE has one of all its words.

    Rows of words are hashed in generated code: several times as fast as a
    function of arrays, which is interpreted.
    """
    rows = words.select(*columns, "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select(*columns, F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(SHINGLE)]).alias("token"))


def _token_arrays(words: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and t, the distinct tokens of each line, the same numbers as those of _exploded()."""
    # words are read by place, from the bound array itself: each step within the function costs more than the hash
    tokens = let(F.col("w"), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, SHINGLE)])))
    return words.select(*columns, F.array_distinct(F.slice(tokens, F.lit(1), F.col("n"))).alias("t"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, version, text, row): the keys of a row, its text, and its other columns."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    return docs.select(doc.alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text", F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("row"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, version, line_no, line) of the lines that take part, in normal form."""
    # normal forms come out of the generator, so that the filter below does not make them again
    parts = F.transform(F.split("text", "\n"), normal)
    return _keyed(docs).select("doc", "version", F.posexplode_outer(parts).alias("line_no", "line")).filter(F.col("line") != "")


def _identity() -> list[Column]:
    """96 bits that equal lines share."""
    return [F.xxhash64("line").alias("s1"), F.hash("line").alias("s2")]


def _needed(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100).cast("int")


def _prefix(n: Column) -> Column:
    """Length of the prefix of a set of n tokens: two similar sets share one of them."""
    return n - _needed(n) + 1


def _cell(token: Column) -> Column:
    return token.bitwiseAND(F.lit(CELLS - 1).cast("bigint")).cast("int")


def _rarity(lines: DataFrame) -> list[int]:
    """For each cell of the table a class: 0 for counts that chance explains, then one for each doubling of what is beyond."""
    counts = _exploded(_words(lines)).select(_cell(F.col("token")).alias("cell")).groupBy("cell").count().collect()  # CELLS rows at most
    usual = sorted(r["count"] for r in counts)[len(counts) // 2] if counts else 1
    chance = usual + 4 * math.sqrt(usual)
    classes = [0] * CELLS
    for r in counts:
        classes[r.cell] = max(0, math.ceil(math.log2(max(r["count"] - chance, 0.5))))
    return classes


def prefixes(lines: DataFrame, classes: list[int], *columns: str) -> DataFrame:
    """``columns``, the number n of distinct tokens and t, those of the prefix by rarity.

    A token is a number that holds its class above 56 bits of the hash, so that
    numbers of class 0 come as their hashes do.  If the first tokens by hash, some
    more than the prefix, hold a prefix of class 0, then that is the line's; else
    all its tokens are given their class and sorted.
    """
    table = F.from_json(F.lit(str([c << _TOKEN_BITS for c in classes])), "array<bigint>")
    zero = F.lit(0).cast("bigint")
    ranked = lambda hashes: F.sort_array(F.transform(hashes, lambda h: F.coalesce(F.get(table, _cell(h)), zero) + F.shiftright(h, 64 - _TOKEN_BITS)))
    cut = lambda tokens: F.slice(tokens, F.lit(1), F.col("p"))
    hashes = _token_arrays(_words(lines, *columns), *columns).select(*columns, F.sort_array("t").alias("h"))
    sized = hashes.select(*columns, "h", F.size("h").alias("n"), _prefix(F.size("h")).alias("p"))
    few = sized.select(*columns, "h", "n", "p", ranked(F.slice("h", F.lit(1), F.col("p") + F.shiftright("p", 2) + 2)).alias("t"))
    return few.select(*columns, "n", F.when(F.get("t", F.col("p") - 1) < F.lit(1 << (_TOKEN_BITS - 1)), cut("t")).otherwise(cut(ranked("h"))).alias("t"))


def postings(lines: DataFrame, classes: list[int]) -> DataFrame:
    """(token, id, doc, n, i): tokens of each line's prefix with their places."""
    return prefixes(lines, classes, "id", "doc").select("id", "doc", "n", F.posexplode_outer("t").alias("i", "token"))


def _length(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _positions(a: str, b: str) -> Column:
    """Whether what may still be shared from this token on suffices; true of the first shared token of a match."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(na - F.col(f"{a}.i"), nb - F.col(f"{b}.i")) * (100 + PERCENT) >= PERCENT * (na + nb)


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether two sets may be similar that share so many tokens of their prefixes.

    Tokens shared beyond the prefix that ends first are among the rest of that
    set.  No two lines share more than either has in lists of several lines.
    """
    return (shared + _needed(F.greatest(n, m)) - 1) * (100 + PERCENT) >= PERCENT * (n + m)


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: whether column ``key`` may be one of ``keys``, so that a join with few rows moves few.

    What is broadcast is a bitmap: at most CELLS rows of 64 bits.
    """
    h = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    words = keys.groupBy(_cell(h).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    held = rows.withColumn("cell", _cell(h)).join(F.broadcast(words), "cell", "left")
    return held.withColumn("marked", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("cell", "bits")


def compared(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, at, t): place and distinct tokens of the lines ``ids``, made once a line, not once a pair."""
    own = _token_arrays(_words(_marked(lines, "id", ids).filter("marked").join(ids, "id", "left_semi"), "id", "doc", "line_no", "version"), "id", "doc", "line_no", "version")
    return own.select("id", F.struct("doc", "line_no", "version").alias("at"), "t")


def verify(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """id of the line of each pair (id, other) that is proved similar to an earlier one: the later of the two."""
    own = _marked(own, "id", pairs.select(F.explode(F.array("id", "other")).alias("id"))).filter("marked")
    side = lambda name, x: own.select(F.col("id").alias(name), F.col("t").alias(f"t_{x}"), F.col("at").alias(f"at_{x}"))
    similar = (100 + PERCENT) * F.size(F.array_intersect("t_a", "t_b")) >= PERCENT * (F.size("t_a") + F.size("t_b"))
    both = pairs.join(side("id", "a"), "id").join(side("other", "b"), "other").filter(similar)
    return scratch.materialise(both.select(F.when(F.col("at_a") > F.col("at_b"), F.col("id")).otherwise(F.col("other")).alias("id")).distinct(), "settled")


def representatives(lines: DataFrame) -> DataFrame:
    """First occurrence of each distinct line, how often it stands, and a number of its own."""
    first = F.min(F.struct("doc", "line_no", "version", "line")).alias("first")
    distinct = lines.select(*_identity(), "doc", "line_no", "version", "line").groupBy("s1", "s2").agg(first, F.count("*").alias("k")).select("s1", "s2", "k", "first.*")
    return distinct.withColumn("id", F.monotonically_increasing_id())


def similar_to_earlier(lines: DataFrame, classes: list[int]) -> DataFrame:
    """id of the lines that an earlier one matches."""
    # most tokens stand in one line: what follows reads the others only, and one shuffle is all that the postings go through
    token = Window.partitionBy("token")
    posted = postings(lines, classes).select("*", F.min("doc").over(token).alias("first"), F.count("*").over(token).alias("k"))
    shared, beside = scratch.stored(posted.filter("k > 1"), "shared")
    hubs = shared.filter("doc = first").groupBy("token").agg(F.min(F.struct("id", "n", "i")).alias("hub")).select("token", "hub.*")
    pairs = shared.alias("a").join(hubs.alias("h"), "token").filter("a.id <> h.id")
    pairs = pairs.select(F.col("a.id").alias("id"), F.col("h.id").alias("other"), (_length("a.n", "h.n") & _positions("a", "h")).alias("passes"), (F.col("k") > 2).alias("more"))
    stars, path = scratch.stored(pairs.groupBy("id", "other").agg(F.max("passes").alias("passes"), F.max("more").alias("more")), "stars")

    own, tokens = scratch.stored(compared(lines, stars.filter("passes or more").select(F.explode(F.array("id", "other")).alias("id")).distinct()), "compared")
    tried = stars.filter("passes").select("id", "other")
    settled = verify(tried, own)
    # a line that is not settled may match another line of its tokens than the first
    open_ = stars.filter("more").select(F.explode(F.array("id", "other")).alias("id")).distinct().join(settled, "id", "left_anti")
    counts = shared.groupBy("id").agg(F.count("*").cast("int").alias("e"))
    shared, at = scratch.stored(shared.join(counts, "id").select("token", "id", "doc", "n", "i", "e"), "weighed")
    scratch.remove(lines.sparkSession, beside)
    later, beside = scratch.stored(shared.join(open_, "id", "left_semi"), "later")
    both = later.alias("a").join(shared.alias("b"), "token").filter(
        (F.col("b.doc") <= F.col("a.doc")) & (F.col("a.id") != F.col("b.id")) & _length("a.n", "b.n") & _enough(F.least("a.e", "b.e"), F.col("a.n"), F.col("b.n")))
    pairs = both.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(
        F.count("*").alias("shared"), F.max(_positions("a", "b")).alias("passes"))
    pairs = pairs.filter(F.col("passes") & _enough(F.col("shared"), F.col("n"), F.col("m"))).select("id", "other")
    pairs, place = scratch.stored(pairs.join(tried, ["id", "other"], "left_anti"), "pairs")
    settled = settled.unionByName(verify(pairs, own)).distinct()
    for done in (path, beside, at, place, tokens):
        scratch.remove(lines.sparkSession, done)
    return settled


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, version, gone): numbers of the lines to remove, of documents that have some; a stored table."""
    spark = docs.sparkSession
    lines = _lines(docs)
    reps, path = scratch.stored(representatives(lines), "lines")
    similar = similar_to_earlier(reps, _rarity(reps))
    firsts = reps.select("s1", "s2", "id", "k", F.col("doc").alias("d"), F.col("line_no").alias("at"), F.col("version").alias("v")).join(
        similar.withColumn("near", F.lit(True)), "id", "left").filter(F.col("near") | (F.col("k") > 1))
    own = lines.select(*_identity(), "doc", "version", "line_no").join(firsts, ["s1", "s2"])
    gone = own.filter(F.col("near") | (F.col("doc") != F.col("d")) | (F.col("line_no") != F.col("at")) | (F.col("version") != F.col("v")))
    found = scratch.materialise(gone.groupBy("doc", "version").agg(F.collect_set("line_no").alias("gone")), "gone")
    scratch.remove(spark, path)
    return found


def added(docs: DataFrame) -> tuple[str, str]:
    """Names of the two added columns."""
    return fresh("n_lines", docs.columns), fresh("n_removed", docs.columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the numbers of its lines and of those removed, named as added() says."""
    repeated, rows = repeated_lines(docs), _keyed(docs)
    # texts that stay as they are do not move
    rows = _marked(rows, "doc", repeated.select("doc"))
    same = rows.filter("not marked").withColumn("gone", F.lit(None).cast("array<int>"))
    rows = rows.filter("marked").join(repeated, ["doc", "version"], "left").unionByName(same)
    kept = let(F.split("text", "\n"), lambda parts: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")
    return rows.select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        *[value.alias(name) for value, name in zip((n_lines, n_removed), added(docs), strict=True)])
