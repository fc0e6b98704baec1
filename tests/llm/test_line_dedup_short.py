import re

import numpy as np

from pathweave.llm import line_dedup


def words(line):
    return tuple(w for w in re.split(r"[\x09-\x0D\x20]+", line.lower()) if w)


def brute(rows, percent):
    """As in test_line_dedup, with all words of a line of one to four as its one token."""
    def tokens(line):
        w = words(line)
        return frozenset(w[i : i + 5] for i in range(max(len(w) - 4, 1))) if w else frozenset()

    lines = [((d, k), tokens(x)) for d, t in rows for k, x in enumerate(t.split("\n"))]
    out = []
    for d, t in rows:
        parts = t.split("\n")
        gone = {k for k, x in enumerate(parts) if any(p < (d, k) and y and 100 * len(tokens(x) & y) >= percent * len(tokens(x) | y) for p, y in lines)}
        out.append((d, "\n".join(x for k, x in enumerate(parts) if k not in gone), len(parts), len(gone)))
    return sorted(out)


def dedup(spark, rows):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_short_lines_that_repeat_go(spark):
    rows = [(1, "All rights reserved.\n\nles."), (2, "les.\n  ALL  rights\treserved. \n\nAll rights"), (3, "all rights\n\n \nrights all")]
    assert dedup(spark, rows) == [(1, "All rights reserved.\n\nles.", 3, 0), (2, "\nAll rights", 4, 2), (3, "\n \nrights all", 4, 1)]


def test_short_and_long_lines_against_brute_force(spark):
    rng = np.random.default_rng(7)
    line = lambda: "  ".join(rng.choice(list("abC"), rng.integers(0, 8)))
    rows = [(i, "\n".join(line() for _ in range(rng.integers(1, 12)))) for i in range(60)]
    got = dedup(spark, rows)
    assert got == brute(rows, line_dedup.PERCENT) and sum(r[3] for r in got) > 100
