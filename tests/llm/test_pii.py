"""Base spans against plain regular expressions; the supervision against its definition; added spans by hand."""

import hashlib
import random
import re

import pytest

from pathweave.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def card(rng, first="4"):
    digits = first + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


ODD = [None, "", "@", "a@b", "a@b.c", "a@b.c_d@e.f", "a.b@c.d@e.f", "é€a@b.cd\U0001f600x@y.zz", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 000001.0.0.255", "0000256.1.1.1", "+1 (017) 555-7713", "+1+22 33 44 55 66",
       "+49 (0) 30 - 12.34.56 - ", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111 4111111111111111", "1" * 25, "+" * 30 + "1", "٣.٤.٥.٦", "x@-.-", "a@b..c", "%@%.%", "+1-----------9", "٠@a.b", "9 9-9 9-9 9-9 9-9 9-9 4"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(3)
    pieces = list("@@..++--  ()1234567890aé\n_") + ["\U0001f600", "4111111111111111", "a@b.c", "10.0.0.1", "+1 ", "555-1234"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    for r in pii.find_spans(frame(spark, texts)).collect():
        assert [(s.start, s.kind_no - 1, s.end, s.kind) for s in r.spans if s.base] == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_long_runs_take_linear_time(spark):
    ip = lambda step, n: [(i * step, 1, i * step + 7, "ip") for i in range(n)]
    cases = [
        ("a" * 1_500_000, []), ("1" * 1_500_000, []), ("1." * 400_000, ip(8, 100_000)), ("a@b" + ".c" * 700_000, [(0, 0, 1_400_003, "email")]), ("+1" + " 1" * 700_000, []),
        ("1 " * 700_000, []), ("1.2.3.4 " * 40_000, ip(8, 40_000)), ("(" * 1_000_000, []), ("ab:" * 400_000, [])]
    got = {r.doc_id: [(s.start, s.kind_no - 1, s.end, s.kind) for s in r.spans if s.base] for r in pii.find_spans(frame(spark, [t for t, _ in cases])).collect()}
    assert [got[i] == want for i, (_, want) in enumerate(cases)] == [True] * len(cases)


def test_added_spans(spark):
    rng = random.Random(4)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    texts = [f"Please call +1 ({n(3)}) {n(3)}-{n(4)} or mail bob{i}@mail.example.com from host {rng.randint(11, 99)}.20.30.{i}; card {card(rng)} ok" for i in range(150)]
    clean = ["version 1.2.3.400 of the text, section 4.5.6.7.8", "order 4111111111111112 was sent", "in 1999-2004 some 12 345 678 people", "x = 123-456-7890123", "meet at (dot) the at sign"]
    extra = [f"mail jane{n(2)} [at] corp [dot] com today", f"phone: ({n(3)}) {n(3)}-{n(4)} now"]
    got = {r.doc_id: r.spans for r in pii.find_spans(frame(spark, texts + clean + extra)).collect()}
    added = {i: [s for s in spans if not s.base] for i, spans in got.items()}
    assert all(not added[i] for i in range(len(texts) + len(clean)))
    assert all(s.score > 0.5 for i in range(len(texts)) for s in got[i])
    for i, t in enumerate(texts + clean):
        assert [(s.start, s.kind_no - 1, s.end, s.kind) for s in got[i]] == base_spans(t)
    for i, t in enumerate(extra, len(texts) + len(clean)):
        for s in added[i]:
            assert s.score >= pii.ADD and s.kind == ("email" if "[at]" in t[s.start:s.end] else "phone")
    assert [s.kind for s in added[len(texts) + len(clean) + 1]] == ["phone"]


def test_no_added_span_overlaps_a_base_span(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["4111.1111.1111.1111", "(415) 555-2671", "+1 (415) 555-2671", "a@b.com", "415 555 2671", "1.2.3.4", "2001:db8:1:1:1:1:1:1"]) for _ in range(6)) for _ in range(80)]
    for r in pii.find_spans(frame(spark, texts)).collect():
        base = [s for s in r.spans if s.base]
        for s in (s for s in r.spans if not s.base):
            assert all(b.end <= s.start or s.end <= b.start for b in base)


def test_estimate_finds_the_reliable_labelers():
    rng = random.Random(6)
    counts, right = {}, [0.95, 0.9, 0.85, 0.5, 0.75]
    truth = {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) * (1 if rng.random() < p else -1) if rng.random() < 0.9 else 0 for p in right)
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    post, chances = pii.estimate(counts)
    assert abs(sum(n * post[v] for v, n in counts.items()) / 20_000 - 0.4) < 0.03
    assert all(abs(post[v] - truth[v] / n) < 0.15 for v, n in counts.items() if n > 300)
    rate = [c[1, 1] / (c[1, 1] + c[-1, 1]) for c in chances]
    assert rate[0] > rate[1] > rate[4] > rate[3] and abs(rate[3] - 0.5) < 0.05


def test_weights_are_naive_bayes():
    bias, w = pii.weights([("a=1", 8.0, 2.0), ("a=2", 2.0, 8.0)], 1)
    assert bias == 0 and w["a=1"] == pytest.approx(-w["a=2"]) and w["a=1"] > 1


def test_empty_and_no_spans(spark):
    assert pii.find_spans(frame(spark, ["x", None])).select("spans").collect() == [([],), ([],)]
    assert pii.find_spans(frame(spark, ["x"]).filter("false")).collect() == []


def test_redacted(spark):
    docs = frame(spark, ["write é a@b.com or +1 (415) 555-2671.", "none", None])
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {0: "write é [email] or [phone].", 1: "none", 2: None}


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_pii(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        base, g = base_spans(r.text), got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[3] == k for s in base) for k in BASE]
        assert g.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert set(text_of(base).split(",")) <= {*g.spans.split(","), ""}
