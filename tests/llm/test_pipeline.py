from collections import Counter

import corpus_pipeline
import pytest

from pathweave.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_order(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _, _ in stages] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_each_stage_against_brute_force(stages, spark):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    import test_decontam
    import test_line_dedup
    import test_ngram_join

    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    _, before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model, ["doc_id"]).collect() if r.score >= 0.7}
    assert {d for d, _ in rows(after)} == good and 0 < len(good) < before.count()

    _, before, after = stages[1]
    want = Counter((d, t) for d, t, lines, gone in test_line_dedup.brute(rows(before)) if not gone or gone < lines)
    assert Counter(rows(after)) == want
    assert after.filter("n_chars <> length(text)").count() == 0

    _, before, after = stages[2]
    keep = {d for d, _, c in test_ngram_join.brute(rows(before)) if d == c}
    assert sorted(rows(after)) == sorted((d, t) for d, t in rows(before) if d in keep)

    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in test_decontam.brute(rows(before), items) if not hit}
    assert {d for d, _ in rows(after)} == clean

    _, before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {d for d, _ in rows(before)}


def test_run_gives_the_last_stage(stages, spark):
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, stages[-1][2].select(columns).collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, "en", None, None), (1, "", None, "s", 0), (None, None, None, None, None), (None, "some words of a text without an id " * 3, None, None, 5), (2, "some words of a text " * 5, "en", "s", 9), (2, "some words of a text " * 5, "en", "s", 9), (3, " \n ", "x", "y", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == {1: 1, None: 2, 2: 1, 3: 1}
