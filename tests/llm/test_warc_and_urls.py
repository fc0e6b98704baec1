import gzip
import io

import pytest

from pathweave.llm import queries, url_filter, warc

LONG = "é" * 60


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/x", LONG), (1, "http://a/y", LONG), (2, "http://b", LONG), (4, "u\r\nv w", "short"), (5, None, "short"), (6, "http://c", None), (7, "http://d", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 9),
            (8, "http://d", "line\r\n\r\n\n"), (None, "http://n", LONG), (None, "http://m", "only" * 50), (9, "http://e", "twice" * 40), (9, "http://e", "twice" * 40)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    warc.write_archives(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    got = sorted((str(c.metadata.fields.get("pageId")), c.response.record_type, c.response.payload_bytes, c.response.payload) for c in captures)
    want = []
    for page, _, html in rows:
        html = html or ""
        again = html == LONG and page != 1
        want.append((str(page), "revisit" if again else "response", len(html.encode()), None if again else html))
    assert got == sorted(want, key=str)
    assert all(c.request.record_type == "request" for c in captures)
    for name in (tmp_path / "w").glob("*.gz"):  # each record ends with two line ends
        data = gzip.decompress(name.read_bytes())
        assert data.endswith(b"\r\n\r\n") and len(list(warc.parse_archive(io.BytesIO(data)))) % 3 == 0


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(b"nonsense\r\n")))


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).count() == 0


URLS = [None, "", "no scheme", "http://", "http://COM/en/x", "https://Www.Example.COM/en/7?x=/en/", "http://xcom/en/", "http://a.net/de/1", "http://a.example.net/de/85", "http://example.net/de/9#x",
        "x://b.org?/es/", "http://b.org/es/#", "http://b.org/ES/", "http://u@b.org:80/es/", "a://b://org/es/", "http://com/en", "http://.com/en/", "http://c.org//es/"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(5, URLS[5], "x"), (None, URLS[4], "x")], "page_id long, url string, host string")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, queries.URL_RULES)).collect())
    want = [(i, *judge(u)) for i, u in [*enumerate(URLS), (5, URLS[5]), (-1, URLS[4])]]
    assert got == sorted((i, h, p, str(r), v) for i, h, p, r, v in want)


def test_rule_ties_and_empty_lists(spark):
    rules = url_filter.rules_frame(spark, [("allow", "a.b", "/c"), ("block", "a.b", "/c"), ("allow", "a.b", "/c"), ("allow", "b", "/cc/")])
    pages = spark.createDataFrame([(1, "x://a.b/cc/d")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules.filter("host = 'a.b'")).first().verdict == "block"
    assert url_filter.filter_urls(pages, rules.limit(0)).first().verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
