"""The star-schema tables as a link graph: customers are pages, an order links its customer to the next order's.

No dump files come with the test data, so dump-shaped tables are derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BASE_LINK, _MISSING_LINK = 1_000_000, 2_000_001


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def following_orders(orders: DataFrame, buckets: int = 64) -> DataFrame:
    """(o_orderkey, o_custkey, o_orderpriority, nxt): nxt is the customer of the next order by key.

    Orders are dealt to ranges of keys; only the first order of each range is
    carried to the range before, so no task sees the whole table.
    """
    rows = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    top = rows.agg(F.max("o_orderkey")).first()[0] or 0
    width = top // buckets + 1
    rows = rows.withColumn("range", F.floor(F.col("o_orderkey") / width))
    heads = rows.groupBy("range").agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("head"))  # a row a range
    after = Window.orderBy("range")
    heads = heads.select("range", F.lead("head.o_custkey").over(after).alias("next_head"))
    own = Window.partitionBy("range").orderBy("o_orderkey")
    return rows.withColumn("nxt", F.lead("o_custkey").over(own)).join(F.broadcast(heads), "range").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.coalesce("nxt", "next_head").alias("nxt"))


def raw_edges(spark: SparkSession, sf_dir: str, urgent: bool = False) -> DataFrame:
    """Distinct (src, dst) without redirects or namespaces; ``urgent`` keeps orders of first priority."""
    links = following_orders(read(spark, sf_dir, "orders")).filter(F.col("nxt").isNotNull())
    if urgent:
        links = links.filter(F.col("o_orderpriority").startswith("1"))
    return links.select((F.col("o_custkey") + 1).alias("src"), (F.col("nxt") + 1).alias("dst")).distinct()


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("page_id"), F.when(F.col("c_nationkey") == 24, 1).otherwise(0).alias("page_namespace"),
        F.translate("c_name", "#", "_").alias("page_title"), (F.col("c_acctbal") < 0).alias("page_is_redirect"))


def linktarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page(spark, sf_dir).select((F.col("page_id") + _BASE_LINK).alias("lt_id"), F.col("page_namespace").alias("lt_namespace"), F.col("page_title").alias("lt_title"))
    kind = F.col("o_orderkey") % 10
    missing = read(spark, sf_dir, "orders").filter("o_orderkey % 97 = 0").select(
        (kind + _MISSING_LINK).alias("lt_id"), F.lit(0).alias("lt_namespace"), F.concat(F.lit("Missing_page_"), kind.cast("string")).alias("lt_title")).distinct()
    return pages.unionByName(missing)


def pagelinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = following_orders(read(spark, sf_dir, "orders")).filter(F.col("nxt").isNotNull())
    pages = page(spark, sf_dir).select("page_id", "page_namespace")
    target = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderkey") % 10 + _MISSING_LINK).otherwise(F.col("nxt") + _BASE_LINK + 1)
    return links.join(pages, links.o_custkey + 1 == pages.page_id).select(
        F.col("page_id").alias("pl_from"), F.col("page_namespace").alias("pl_from_namespace"), target.alias("pl_target_id"))


def redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page(spark, sf_dir)
    n = read(spark, sf_dir, "customer").count()
    sources = pages.filter("page_is_redirect and page_id % 5 <> 0").select(F.col("page_id").alias("rd_from"), (((F.col("page_id") - 1) * 7 + 3) % n + 1).alias("target"))
    targets = pages.select(F.col("page_id").alias("target"), F.col("page_namespace").alias("rd_namespace"), F.col("page_title").alias("rd_title"))
    return sources.join(targets, "target").select("rd_from", "rd_namespace", "rd_title")


def dump_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"page": page(spark, sf_dir), "linktarget": linktarget(spark, sf_dir), "pagelinks": pagelinks(spark, sf_dir), "redirect": redirect(spark, sf_dir)}


def top_pages_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document (column value) that ranks customers by their number of orders."""
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("views"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.translate("c_name", "#", "_").alias("article"))
    # the list is a report of a thousand pages
    ranked = n.join(names, "o_custkey").orderBy(F.desc("views"), "o_custkey").limit(1000)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("views"), "o_custkey")))
    articles = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "article", "views"))).alias("a"))
    article = F.transform("a", lambda x: F.struct(x["article"].alias("article"), x["views"].alias("views"), x["rank"].alias("rank")))
    item = F.struct(F.lit("en").alias("project"), F.lit("all").alias("access"), F.lit("2024").alias("year"), F.lit("05").alias("month"), F.lit("all").alias("day"), article.alias("articles"))
    return articles.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each event and the next one of the day's log: source and target are its user and the next one."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("next_user"))
    return events.join(following, "event_id").select(
        (F.col("user_id") + 1).alias("source_page_id"), (F.col("next_user") + 1).alias("target_page_id"), F.col("ts").alias("timestamp"), F.round("value").cast("bigint").alias("duration"))
