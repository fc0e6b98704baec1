from pathweave.operators import toppages


def test_a_list_of_more_than_a_thousand_pages_is_ranked_whole(spark):
    n = 1300
    articles = spark.createDataFrame([(f"p{i}", n - i, i + 1) for i in range(n)], "title string, views long, rank int")
    vertexes = spark.createDataFrame([(i + 1, f"p{i}") for i in range(n) if i % 10], "id long, title string")
    got = [(r.id, r["rank"]) for r in toppages.ranked(articles, vertexes).orderBy("rank").collect()]
    assert got == [(i + 1, k) for k, i in enumerate((i for i in range(n) if i % 10), 1)]
    assert toppages.ranked(articles, vertexes, 10).count() == 10
