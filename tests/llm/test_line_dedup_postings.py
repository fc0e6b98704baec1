"""op3_line_dedup moves its postings once, and tokens are the same numbers however they are made."""

from pyspark.sql import functions as F

from pathweave.llm import line_dedup, scratch

LINES = [(1, "a b c d e f g h"), (2, "a b c d e"), (3, "a b"), (4, "x"), (5, "a a a a a a a a"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_equal_those_of_exploded_rows(spark):
    words = line_dedup._words(spark.createDataFrame(LINES, "id bigint, line string"), "id")
    arrays = {r.id: sorted(r.t) for r in line_dedup._token_arrays(words, "id").collect()}
    rows = {r.id: sorted(r.t) for r in line_dedup._exploded(words, "id").groupBy("id").agg(F.collect_set("token").alias("t")).collect()}
    assert arrays == rows


def test_postings_are_neither_stored_nor_moved_twice(spark, monkeypatch):
    stored, plans = scratch.stored, {}

    def noted(df, name):
        plans[name] = _plan(df)
        return stored(df, name)

    monkeypatch.setattr(scratch, "stored", noted)
    words = [f"w{i}" for i in range(40)]
    docs = [(d, " ".join(words[:39] + [f"v{d}"] + words[39:])) for d in range(4)] + [(9, "nothing like the others here at all")]
    gone = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(r["doc"] for r in gone.collect()) == [1, 2, 3]
    assert "postings" not in plans
    assert plans["shared"].count("Exchange ") == 1
    assert "arrays_zip" not in plans["shared"]
