import random

from pathweave.llm import url_filter
from tests.llm.test_warc_and_urls import judge


def best(url, rules):
    """Rule by trying each one; ties as the operator states them."""
    host, path, _, _ = judge(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_five_thousand_shapes(spark):
    draw = random.Random(5)
    rules = [(draw.choice(["block", "allow"]), ".".join(["a"] * labels), "/" + "x" * length) for labels in range(1, 11) for length in range(500)]
    assert len({(h.count("."), len(p)) for _, h, p in rules}) == 5000
    urls = ["http://" + ".".join(["a"] * draw.randint(1, 14)) + "/" + "x" * draw.randint(0, 600) + draw.choice(["", "y", "?x"]) for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://b/x", "http://a", "http://a/" + "x" * 1_200_000])), "page_id long, url string")
    want = {i: best(u, rules) for i, u in pages.collect()}
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == want and {v for _, v in got.values()} == {"allow", "block"}
