"""Main text of web pages, with a suffix array of each host's boilerplate.

A page is read into blocks of text, each known to stand inside or outside a
main region (article, or else main) and inside or outside a part that is never
main text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), by element, role and class names.

All text outside main regions, of all pages of a host, is laid end to end as a
token stream.  Its suffixes are sorted, to a depth of ``min_run`` tokens, in
each task; runs of equal prefixes are sent once with their least and greatest
page, and a run that two pages of the host share is boilerplate.  Pages without
a main region lose the tokens that boilerplate covers and keep the rest; a page
that boilerplate covers whole (a copy) keeps all.  Text inside a main region is
protected: articles that stand on several pages are main text on each.

Defined cases: null html is empty; a truncated page ends where it ends; a null
url has an empty host; a very long page is parsed whole; repeated rows are pages of equal text, of which each
shows the other's text as repeated, so that they keep it whole.  Extra columns
are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm import bytetext, suffix_dedup, url_filter

#: Tokens of a repeated run, at least.
MIN_RUN = 8

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot"
    " th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
NEVER = frozenset("button canvas datalist dialog fieldset head iframe label legend menu nav noembed noframes noscript object option script search select style svg template textarea title xmp".split())
LAYOUT = frozenset("aside footer form header".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = frozenset("comment comments commentlist commenter disqus discussion replies reply respond responses".split())
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies"
    " footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo"
    " promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets".split())
#: An opening tag of these ends an open one of the same kind.
_CLOSES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
_INLINE_PARENTS = BLOCKS - {"p", "br", "hr"}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++))""")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str
    main: int  # 2 in an article, 1 in a main element
    dropped: bool
    region: int = 0  # number of the outermost article or main element around it
    wrapped: bool = False  # whether that, or an article inside it, opened in a part that is never main text


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _region(name: str, raw: str) -> tuple[int, str]:
    """(main region that opens, why the element is never main text: '', 'layout' or 'never')."""
    attributes = _attributes(raw)
    role = attributes.get("role", "").strip().lower()
    words = set(_NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) if "class" in attributes or "id" in attributes else set()
    if name in NEVER or words & COMMENTS and name not in ("html", "body", "main"):
        return 0, "never"
    if name == "article" or role == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return 2, ""
    if name == "main" or role == "main":
        return 1, ""
    if name in ("html", "body"):
        return 0, ""
    if name in LAYOUT or role in ROLES or words & NAMES:
        return 0, "layout"
    return 0, ""


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page, in order; white space is collapsed and character references decoded."""
    out: list[Block] = []
    #: (element, main, why, region, wrapped) of open elements, as they hold inside
    stack: list[tuple[str, int, str, int, bool]] = []
    main, why, region, wrapped, regions, parts, at, size = 0, "", 0, False, 0, [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, main, bool(why), region, wrapped))
            parts.clear()

    def back_to(depth: int) -> None:
        nonlocal main, why, region, wrapped
        del stack[depth:]
        _, main, why, region, wrapped = stack[-1] if stack else ("", 0, "", 0, False)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if (stack[depth][1], stack[depth][2]) != (stack[depth - 1][1:3] if depth else (0, "")):
                        flush()
                    back_to(depth)
                    break
            continue
        if at >= size and page[-1:] != ">":
            break  # the page ends within a tag
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            stops = _CLOSES.get(name)
            for depth in range(len(stack) - 1, -1, -1):
                other = stack[depth][0]
                if other == name and stops is not None or other == "p" and stops is None:
                    back_to(depth)
                    break
                if other in (stops or _INLINE_PARENTS):
                    break
        opens, drops = _region(name, m[3]) if name in BLOCKS or "=" in m[3] or name in NEVER else (0, "")
        if opens and why != "never" or drops:
            flush()
        if opens and why != "never" and (opens > main or not main):
            # a layout wrapper may hold the article or a teaser: parse() decides
            if not main:
                regions += 1
                region = regions
            wrapped = wrapped or bool(why)
            main, why = opens, ""
        elif drops and why != "never":
            why = drops
        stack.append((name, main, why, region, wrapped))
    if at < size:
        rest = page[at:]
        parts.append(rest)
    flush()
    return out


@dataclass
class Parsed:
    text: str | None  # of the main region; None without one
    open: list[str]  # blocks of a page without main region that may be main text
    outside: list[str]  # all blocks outside of main regions


def _size(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def parse(page: str) -> Parsed:
    """Of the main regions of a page, those that no layout part wraps; where all are wrapped, these if they are most of the page.

    Articles go before the text around them in a main element, and before main
    elements without articles unless those have more text.
    """
    found = blocks(page)
    kept = [b for b in found if not b.dropped]
    free, own, rest = [b for b in kept if b.main and not b.wrapped], [b for b in kept if b.main], [b for b in kept if not b.main]
    outside = [b.text for b in found if not b.main]
    own = free or (own if _size(own) >= _size(rest) else [])
    if own:
        articles = [b for b in own if b.main == 2]
        with_articles = {b.region for b in articles}
        others = [b for b in own if b.region not in with_articles]
        return Parsed(" ".join(b.text for b in (articles if _size(articles) >= _size(others) else others)), [], outside)
    return Parsed(None, [b.text for b in rest], outside)


def _token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by text, hash of each token); tokens are runs of anything but white space."""
    hashes, bounds, seen = [np.zeros(0, np.uint64)], [0], 0
    for chunk in bytetext.chunks(pa.array(texts, pa.string())):
        w = bytetext.words(chunk, "blank")
        hashes.append(w.hash)
        bounds += (seen + np.searchsorted(w.doc, np.arange(1, chunk.last - chunk.first + 1))).tolist()
        seen += len(w.hash)
    return np.array(bounds), np.concatenate(hashes)


def _run_hash(prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    return bytetext.mix(bytetext.span_hashes(prefix, start, start + n)).view(np.int64)


def repeated_prefixes(hosts: np.ndarray, pages: np.ndarray, streams: list[str], n: int) -> tuple[np.ndarray, ...]:
    """(host, hash of run, least page, greatest page) of the distinct ``n``-token prefixes of a suffix array of each host."""
    bounds, tokens = _token_hashes(streams)
    owner = np.repeat(np.arange(len(streams)), np.diff(bounds))
    start = np.arange(len(tokens))
    whole = start + n <= bounds[1:][owner] if len(tokens) else np.zeros(0, bool)
    start, owner = start[whole], owner[whole]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    by_host = np.argsort(hosts[owner], kind="stable")
    start, owner = start[by_host], owner[by_host]
    _, rank = np.unique(tokens, return_inverse=True)
    prefix = bytetext.prefix_hashes(tokens)
    order = suffix_dedup.suffix_sort(rank, prefix, start, start + n, hosts[owner])
    start, owner = start[order], owner[order]
    host, page = hosts[owner], pages[owner]
    same = suffix_dedup.common(prefix, start[:-1], start[1:], np.full(len(start) - 1, n)) == n
    first = np.flatnonzero(np.r_[True, ~same | (host[1:] != host[:-1])])
    return host[first], _run_hash(prefix, start[first], n), np.minimum.reduceat(page, first), np.maximum.reduceat(page, first)


def _rows(batch: pa.RecordBatch, size: int = 200) -> Iterator[tuple[list, list[Parsed]]]:
    for at in range(0, batch.num_rows, size):
        rows = batch.slice(at, size).to_pylist()
        yield rows, [parse(r["html"] or "") for r in rows]


def _runs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages, streams = [], [], []
            for rows, parsed in _rows(batch):
                hosts += [r["host_hash"] for r in rows]
                pages += [r["page_hash"] for r in rows]
                streams += [" ".join(p.outside) for p in parsed]
            found = repeated_prefixes(np.array(hosts, np.int64), np.array(pages, np.int64), streams, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["host_hash", "run", "low", "high"])

    return run


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, parsed in _rows(batch):
            own = [(r, p.text) for r, p in zip(rows, parsed, strict=True) if p.text is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["page_id"] for r, _ in own], pa.int64()), pa.array([r["url"] for r, _ in own], pa.string()), pa.array([t for _, t in own], pa.string()),
            ], ["page_id", "url", "text"])


def _open(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, parsed in _rows(batch):
                out = []
                for r, p in zip(rows, parsed, strict=True):
                    if p.text is None:
                        text = " ".join(p.open)
                        _, tokens = _token_hashes([text])
                        prefix = bytetext.prefix_hashes(tokens)
                        starts = np.arange(max(0, len(tokens) - n + 1))
                        out.append({"page_id": r["page_id"], "url": r["url"], "host_hash": r["host_hash"], "page_hash": r["page_hash"], "text": text, "runs": _run_hash(prefix, starts, n).tolist()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("page_id", pa.int64()), ("url", pa.string()), ("host_hash", pa.int64()), ("page_hash", pa.int64()), ("text", pa.string()), ("runs", pa.list_(pa.int64()))]))

    return run


def _uncovered(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tokens = text.split()
                gone = np.zeros(len(tokens), bool)
                for at in covered or []:
                    gone[at : at + n] = True
                texts.append(text if gone.all() else " ".join(t for t, g in zip(tokens, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html",
        F.xxhash64(url_filter.url_host(F.col("url"))).alias("host_hash"), F.xxhash64("page_id", "url", "html").alias("page_hash"))
    text = "page_id bigint, url string, text string"
    done = rows.mapInArrow(bytetext.lean(_main), text)
    # one row for each distinct run of a host and task, and no more than two pages of it
    runs = rows.select("html", "host_hash", "page_hash").mapInArrow(bytetext.lean(_runs(min_run)), "host_hash bigint, run bigint, low bigint, high bigint")
    repeated = runs.groupBy("host_hash", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("host_hash", "run")
    bare = rows.mapInArrow(bytetext.lean(_open(min_run)), f"{text.replace(', text', ', host_hash bigint, page_hash bigint, text')}, runs array<bigint>")
    covered = (
        bare.select("host_hash", "page_hash", F.posexplode("runs").alias("at", "run")).join(repeated, ["host_hash", "run"])
        .groupBy("page_hash").agg(F.collect_set("at").alias("covered"))
    )
    cleared = bare.drop("runs").join(covered, "page_hash", "left").select("page_id", "url", "text", "covered").mapInArrow(bytetext.lean(_uncovered(min_run)), text)
    return done.unionByName(cleared).withColumn("n_chars", F.length("text").cast("bigint"))
