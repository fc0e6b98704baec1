"""Pages by id, title, prefix or chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions import canonical_title

#: Bytes of a row group of the title index.
TITLE_GROUP = 4 << 20


def by_title(vertexes: DataFrame, title: str) -> DataFrame:
    """Exact and case-sensitive, after underscores have become spaces."""
    return vertexes.filter(F.col("title") == canonical_title(F.lit(title)))


def by_id(vertexes: DataFrame, id_: int) -> DataFrame:
    return vertexes.filter(F.col("id") == id_)


def titles(vertexes: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, id, is_redirect, to_id, to_title): pages by title, redirects with the page that they lead to."""
    known = redirects.join(vertexes.select(F.col("id").alias("to_id"), F.col("title").alias("to_title")), "to_id")
    return vertexes.join(known.withColumnRenamed("from_id", "id"), "id", "left").select(
        "title", "id", "is_redirect", *[F.when(F.col("is_redirect"), F.col(c)).alias(c) for c in ("to_id", "to_title")])


def write_titles(titles: DataFrame, path: str, group_bytes: int = TITLE_GROUP) -> None:
    """Store pages in the order of their titles, in small row groups with Bloom filters: a lookup or prefix search reads few of them."""
    titles.repartitionByRange("title").sortWithinPartitions("title", "id").write.mode("overwrite").option("parquet.block.size", group_bytes).option(
        "parquet.bloom.filter.enabled#title", "true").parquet(path)


def search_prefix(titles: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """(position, id, title) of the first titles with a prefix, redirects followed once; a page that is hit again stands at its first position.

    ``titles`` is the index. Redirects without a target stand for themselves.
    """
    hits = by_prefix(titles, prefix, limit)
    # of at most ``limit`` rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("title", "id"))
    pages = hits.select(place.alias("position"), F.coalesce("to_id", "id").alias("id"), F.coalesce("to_title", "title").alias("title"))
    return pages.groupBy("id", "title").agg(F.min("position").alias("position")).select("position", "id", "title").orderBy("position")


def by_prefix(vertexes: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    return vertexes.filter(F.col("title").startswith(canonical_title(F.lit(prefix)))).orderBy("title", "id").limit(limit)


def max_id(vertexes: DataFrame) -> DataFrame:
    return vertexes.agg(F.max("id").alias("max_id"))


def next_page(vertexes: DataFrame, at_least: int) -> DataFrame:
    """The page of least id from ``at_least`` on that is no redirect."""
    return vertexes.filter((F.col("id") >= at_least) & ~F.col("is_redirect")).orderBy("id").limit(1)


def random_page(vertexes: DataFrame, seed: int | None = None, attempts: int = 10) -> dict | None:
    """A page by a drawn id, not uniform over pages: the next one that is no redirect. None if there is none."""
    import random

    top, draw = max_id(vertexes).first()[0], random.Random(seed)
    for _ in range(attempts if top else 0):
        found = next_page(vertexes, draw.randrange(top) + 1).first()
        if found:
            return {"id": found["id"], "title": found["title"]}
    return None


def random_pages(vertexes: DataFrame, n: int = 2, seed: int | None = 0) -> DataFrame:
    return vertexes.filter(~F.col("is_redirect")).orderBy(F.rand(seed), "id").limit(n)
