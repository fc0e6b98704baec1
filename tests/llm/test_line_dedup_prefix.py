"""op3_line_dedup's prefixes are the first tokens by class and hash, however they are found, and texts move once."""

import numpy as np
from pyspark.sql import functions as F

from pathweave.llm import line_dedup


def test_prefixes_are_the_first_tokens_by_class_and_hash(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    lines = [(i, " ".join(rng.choice(words, rng.integers(1, 90)))) for i in range(200)]
    df = spark.createDataFrame(lines, "id bigint, line string")
    tokens = {r.id: set(r.t) for r in line_dedup._token_arrays(line_dedup._words(df, "id"), "id").collect()}
    for share in (0, 0.05, 0.6, 1):
        classes = np.where(rng.random(line_dedup.CELLS) < share, rng.integers(1, 9, line_dedup.CELLS), 0).tolist()
        for r in line_dedup.prefixes(df, classes, "id").collect():
            key = sorted((classes[h & (line_dedup.CELLS - 1)], h >> 8) for h in tokens[r.id])
            n = len(key)
            assert r.n == n and r.t == [(c << 56) + h for c, h in key[: n - -(-n * line_dedup.PERCENT // 100) + 1]]


def test_classes_are_looked_up_for_the_first_tokens_only(spark):
    plan = line_dedup.prefixes(spark.createDataFrame([(1, "a b c d e f g")], "id bigint, line string"), [0] * line_dedup.CELLS, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(slice(h#" in plan


def test_texts_move_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id bigint, text string, lang string")
    keyed = line_dedup._keyed(docs)
    assert keyed.schema["row"].dataType.names == ["doc_id", "lang"]
    assert [tuple(r) for r in line_dedup.dedup_lines(docs.unionAll(docs.withColumn("doc_id", F.lit(2)))).orderBy("doc_id").collect()] == [(1, "a b c d e f", "x", 1, 0), (2, "", "x", 1, 1)]
