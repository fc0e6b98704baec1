"""Links in web pages: a link source beside the dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of every href attribute, in order."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))
