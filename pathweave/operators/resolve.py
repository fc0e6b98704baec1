"""Dump tables to vertices and edges: filters, title joins and one-hop redirects, all equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions import canonical_title


def vertexes(page: DataFrame) -> DataFrame:
    return page.filter("page_namespace = 0").select(F.col("page_id").alias("id"), canonical_title(F.col("page_title")).alias("title"), F.col("page_is_redirect").alias("is_redirect"))


def link_targets(linktarget: DataFrame) -> DataFrame:
    return linktarget.filter("lt_namespace = 0").select(F.col("lt_id").alias("id"), canonical_title(F.col("lt_title")).alias("title"))


def redirects(redirect: DataFrame, vertexes: DataFrame) -> DataFrame:
    """(from_id, to_id): the page of the target's title, whether or not that is a redirect itself.

    One row for each from_id: of several the one written last, by their
    ``ordinal`` in the dump.  Rows without one have no order, and of these the
    greatest to_id stays.
    """
    placed = ["ordinal"] if "ordinal" in redirect.columns else []
    wanted = redirect.filter("rd_namespace = 0").select(F.col("rd_from").alias("from_id"), canonical_title(F.col("rd_title")).alias("title"), *placed)
    found = wanted.join(vertexes.select(F.col("id").alias("to_id"), "title"), "title")
    last = F.max_by("to_id", F.struct("ordinal", "to_id")) if placed else F.max("to_id")
    return found.groupBy("from_id").agg(last.alias("to_id"))


def links(pagelinks: DataFrame, link_targets: DataFrame) -> DataFrame:
    """(src, dest_title) of links from the main namespace to a known target."""
    own = pagelinks.filter("pl_from_namespace = 0").select(F.col("pl_from").alias("src"), F.col("pl_target_id").alias("target"))
    return own.join(link_targets.select(F.col("id").alias("target"), F.col("title").alias("dest_title")), "target").select("src", "dest_title")


def edges(links: DataFrame, vertexes: DataFrame, redirects: DataFrame) -> DataFrame:
    """(src, dst), duplicates kept: a redirect is followed once, on the destination only; without a target it drops the link."""
    ends = vertexes.join(redirects, vertexes.is_redirect & (vertexes.id == redirects.from_id), "left").select(
        F.col("title").alias("dest_title"), F.when(F.col("is_redirect"), F.col("to_id")).otherwise(F.col("id")).alias("dst")).filter("dst is not null")
    return links.join(ends, "dest_title").select("src", "dst")


def unresolved_links(links: DataFrame, vertexes: DataFrame) -> DataFrame:
    """Links whose title no page has."""
    return links.join(vertexes.select(F.col("title").alias("dest_title")), "dest_title", "left_anti").select("src", "dest_title")


def redirect_failures(vertexes: DataFrame, redirects: DataFrame) -> DataFrame:
    """Redirect pages without a target."""
    return vertexes.filter("is_redirect").join(redirects.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "title", "is_redirect")


def resolve(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of the graph from the four dump tables."""
    v, t = vertexes(tables["page"]), link_targets(tables["linktarget"])
    r = redirects(tables["redirect"], v)
    found = links(tables["pagelinks"], t)
    return {
        "vertexes": v, "link_targets": t, "redirects": r, "links": found, "edges": edges(found, v, r),
        "unresolved_links": unresolved_links(found, v), "redirect_failures": redirect_failures(v, r),
    }
