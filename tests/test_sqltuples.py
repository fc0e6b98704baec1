"""Tuples of dump statements, well formed and not."""
import tracemalloc

import pytest

from pathweave.sources import sqldump, sqltuples

HEAD = "INSERT INTO `linktarget` VALUES "


def scanned(text, n=3):
    return [(values, error) for values, _, error in sqltuples.scan(text, 0, n)]


@pytest.mark.parametrize("text, want", [
    ("(1,0,'a'),(2,0,'b');", [(["1", "0", "'a'"], None), (["2", "0", "'b'"], None)]),
    ("(1,0,'a),(2,0,\\'b');", [(["1", "0", "'a),(2,0,\\'b'"], None)]),
    ("(1,0,'a'),(2,0);\n", [(["1", "0", "'a'"], None), (None, "2 values where 3 are due")]),
    ("(1,0,'a'),(2,0,'b;", [(["1", "0", "'a'"], None), (None, "string not closed")]),
    ("(1,0,'a'),(2,0,", [(["1", "0", "'a'"], None), (None, "tuple not closed")]),
    ("(1,(0),'a'),(2,0,'b')", [(None, "parenthesis inside a tuple"), (["2", "0", "'b'"], None)]),
    ("(1,,'a'),(2,0,'b')", [(None, "values not understood"), (["2", "0", "'b'"], None)]),
    ("(1,0,'a')(2,0,'b')", [(["1", "0", "'a'"], None), (None, "no comma after a tuple"), (["2", "0", "'b'"], None)]),
    ("(1,0,'a'), (2,0,'b')", [(["1", "0", "'a'"], None), (None, "no tuple where one is due")]),
    ("(1,0,'a'),", [(["1", "0", "'a'"], None), (None, "no tuple where one is due")]),
    ("x", [(None, "no tuple where one is due")]), ("", []), (";", [(None, "no tuple where one is due")]),
])
def test_scan(text, want):
    assert scanned(text) == want


def test_rows_equal_the_other_reader_and_errors_come_out(spark):
    lines = spark.createDataFrame([(HEAD + "(1,0,'A_b'),(2,0,'it\\'s, (x)'),(3,NULL,'\\\\n');",), (HEAD + "(4,1,'D'),(5,0),(6,0,'F');",), ("INSERT INTO `other` VALUES (9,9,'z');",), ("-- x",)], "value string")
    assert sorted(map(tuple, sqltuples.parse(lines, "linktarget").collect())) == [(1, 0, "A_b"), (2, 0, "it's, (x)"), (3, None, "\\n"), (4, 1, "D"), (6, 0, "F")]
    good = lines.filter("value not like '%(5,0)%'")
    assert sorted(map(tuple, sqltuples.parse(good, "linktarget").collect())) == sorted(map(tuple, sqldump.parse(good, "linktarget").collect()))
    assert [tuple(r) for r in sqltuples.malformed(lines, "linktarget").collect()] == [(1, "(5,0)", "2 values where 3 are due")]


def test_a_statement_of_16_mb_stays_small():
    text = ",".join(f"({i},0,'Title_{i:08d}')" for i in range(620_000)) + ";"
    assert len(text) > 16 << 20
    tracemalloc.start()
    n = sum(1 for values, _, error in sqltuples.scan(text, 0, 3) if error is None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 620_000 and most < 1 << 20
