"""The stored path cache: buckets, latest rows, bounded files."""
import glob

from pyspark.sql import functions as F

from pathweave.operators import cache


def add(spark, made, rows):
    made.add(spark.createDataFrame(rows, "source_page_id long, target_page_id long, t string, path_data string").select(
        "source_page_id", "target_page_id", F.to_timestamp("t").alias("timestamp"), F.lit(0.5).alias("duration"), "path_data"))


def test_many_queries_leave_few_files_and_the_latest_rows(spark, tmp_path):
    path, want = f"{tmp_path}/path", {}
    made = cache.PathCache(spark, path, buckets=2)
    assert made.rows().collect() == []
    for i in range(40):
        pair = (i % 7, i % 3)
        want[pair] = f"[[{i}]]"
        add(spark, made, [(*pair, f"2024-05-01 00:00:{i:02d}", want[pair])])
    files = glob.glob(f"{path}/bucket=*/part-*")
    assert len(files) <= 2 * (cache.FILES + 1)
    assert {(r.source_page_id, r.target_page_id): r.path_data for r in cache.latest(made.rows()).collect()} == want
    pairs = spark.createDataFrame([(1, 1), (6, 2), (50, 50)], "source_id long, target_id long")
    assert {(r.source_id, r.target_id): r.paths for r in cache.hits(pairs, made.rows(pairs)).collect()} == {p: eval(x) for p, x in want.items() if p in ((1, 1), (6, 2))}
    made.compact()
    assert len(glob.glob(f"{path}/bucket=*/part-*")) <= 2 and made.rows().count() == len(want)


def test_a_lookup_reads_the_buckets_of_its_pairs(spark, tmp_path):
    made = cache.PathCache(spark, f"{tmp_path}/path", buckets=16)
    add(spark, made, [(i, i, "2024-05-01 00:00:00", "[]") for i in range(200)])
    one = made.rows(spark.createDataFrame([(5, 5)], "source_id long, target_id long"))
    assert len(one.inputFiles()) == 1 and one.count() < 60
    assert made.rows(spark.createDataFrame([], "source_id long, target_id long")).collect() == []


def test_queries_leave_one_scratch_table(spark):
    from pathweave.plans import queries, storage

    folder = storage.scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/pathweave-*"))
    rows = [queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() for name in ("sssp_same", "adjacency_lists", "top_pages_ranked", "cache_hit_miss")]
    assert rows[0] == 1 and all(rows) and len(set(glob.glob(f"{folder}/pathweave-*")) - before) == len(rows)
