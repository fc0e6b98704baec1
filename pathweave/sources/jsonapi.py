"""JSON documents: dump status and index, monthly top pages, page information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import canonical_title, dump_date, job_time, url_part
from pathweave.schema import DUMP_JOBS, DUMP_STATUS, PAGE_INFO, TOP_PAGES


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one string column ``value``."""
    return spark.read.text(path, wholetext=True)


def _jobs() -> Column:
    return F.array(*[F.col(f"status.jobs.{job}") for job in DUMP_JOBS])


def dump_catalog(documents: DataFrame, column: str = "value") -> DataFrame:
    """(version, complete, dump_date, n_dates, updated): complete if all jobs are done; no date unless all files name the same."""
    parsed = documents.select(F.from_json(column, DUMP_STATUS).alias("status")).select("status.version", _jobs().alias("jobs"))
    urls = F.flatten(F.transform("jobs", lambda j: F.transform(F.map_values(F.coalesce(j["files"], F.from_json(F.lit("{}"), "map<string,struct<size:bigint,url:string,md5:string,sha1:string>>"))), lambda f: f["url"])))
    dates = parsed.select(
        "version",
        F.forall("jobs", lambda j: F.coalesce(j["status"] == "done", F.lit(False))).alias("complete"),
        F.array_distinct(F.transform(urls, lambda u: url_part(u, 3))).alias("dates"),
        F.array_max(F.transform("jobs", lambda j: job_time(j["updated"]))).alias("updated"))
    return dates.select(
        "version", "complete", F.when(F.size("dates") == 1, dump_date(F.get("dates", F.lit(0)))).alias("dump_date"), F.size("dates").alias("n_dates"), "updated")


def latest_dump(catalog: DataFrame) -> DataFrame:
    """The newest complete dump."""
    return catalog.filter("complete and dump_date is not null").orderBy(F.desc("dump_date")).limit(1)


def dump_files(documents: DataFrame, column: str = "value") -> DataFrame:
    """(job, name, url, size, sha1): every file of every job."""
    parsed = documents.select(F.from_json(column, DUMP_STATUS).alias("status"))
    jobs = F.array(*[F.struct(F.lit(job).alias("job"), F.col(f"status.jobs.{job}.files").alias("files")) for job in DUMP_JOBS])
    return parsed.select(F.explode(jobs).alias("j")).select("j.job", F.explode("j.files").alias("name", "f")).select("job", "name", "f.url", "f.size", "f.sha1")


def top_pages(documents: DataFrame, column: str = "value") -> DataFrame:
    """(title, views, rank) of the listed articles."""
    items = documents.select(F.explode(F.from_json(column, TOP_PAGES)["items"]).alias("i")).select(F.explode("i.articles").alias("a"))
    return items.select(canonical_title(F.col("a.article")).alias("title"), "a.views", "a.rank")


def page_info(documents: DataFrame, column: str = "value") -> DataFrame:
    """(id, title) of the pages that exist, main namespace only."""
    pages = documents.select(F.explode(F.map_values(F.from_json(column, PAGE_INFO)["query"]["pages"])).alias("p"))
    return pages.filter("p.missing is null and p.ns = 0").select(F.col("p.pageid").alias("id"), "p.title")
