import re

import numpy as np
import pytest

from pathweave.llm import line_dedup


def tokens(line):
    words = [w for w in re.split(r"[\x09-\x0D\x20]+", line.lower().strip(" \t\n\r\x0b\x0c")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    lines = [((d, k), tokens(x), r) for r, (d, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    out = []
    for r, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept, gone = [], 0
        for k, x in enumerate(t.split("\n")):
            mine = tokens(x)
            again = bool(mine) and any(p < (d, k) and y and 100 * len(mine & y) >= 75 * len(mine | y) for p, y, _ in lines)
            gone += again
            if not again:
                kept.append(x)
        out.append((d, "\n".join(kept), len(t.split("\n")), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 4)))
    pool = [[word() for _ in range(rng.integers(3, 60))] for _ in range(15)]
    common = [word() for _ in range(12)]

    def line():
        x = list(pool[rng.integers(len(pool))])
        for _ in range(rng.integers(0, 3)):
            x[rng.integers(len(x))] = word()
        return "  ".join(x + common * int(rng.random() < 0.2)) + " " * int(rng.integers(0, 2))

    rows = [(i, "\n".join(line() for _ in range(rng.integers(0, 7)))) for i in rng.permutation(50).tolist()]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, rows[0][1]), (64, rows[0][1].upper()), (64, rows[0][1].upper())]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, line string, rid string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_null_ids_come_last(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (None, text), (9, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in line_dedup.dedup_lines(docs).collect()) == [(False, text), (True, ""), (True, "")]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
