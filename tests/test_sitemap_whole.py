from pathweave.plans import queries

SF = "/root/testdata/sf0.01"


def test_sitemap_takes_every_listed_page(spark):
    ids = [r.id for r in queries.top_pages_ranked(spark, SF).orderBy("rank").collect()]
    due = 1 + len(ids) * (len(ids) - 1)
    assert len(ids) > 300
    urls = queries.sitemap_urls(spark, SF)
    assert urls.count() == urls.select("url").distinct().count() == due
    ends = {r.position: r.url for r in urls.filter(f"position in (0, 1, {due - 1})").collect()}
    assert ends == {0: queries.BASE_URL, 1: f"{queries.BASE_URL}/paths/{ids[0]}/{ids[1]}", due - 1: f"{queries.BASE_URL}/paths/{ids[-1]}/{ids[-2]}"}
    chunks = sorted((r.chunk, r.n_urls) for r in queries.sitemap_chunks(spark, SF).collect())
    assert chunks == [(k, min(50_000, due - 50_000 * k)) for k in range(-(-due // 50_000))]
