"""Scalar functions over titles, dates and paths, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_title(title: Column) -> Column:
    """Titles are stored with spaces; sources write underscores."""
    return F.translate(title, "_", " ")


def url_title(title: Column) -> Column:
    return F.translate(title, " ", "_")


def dump_date(text: Column) -> Column:
    """YYYYMMDD as a date; null if it is none."""
    return F.try_to_date(text, "yyyyMMdd")


def job_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def previous_month(day: Column) -> Column:
    """The month before a date as yyyy/MM, by which monthly page views are named."""
    return F.date_format(F.add_months(day, -1), "yyyy/MM")


def days_before(day: Column, n: int) -> Column:
    """The date n days earlier as yyyyMMdd, by which dumps are named."""
    return F.date_format(F.date_sub(day, n), "yyyyMMdd")


def url_part(url: Column, n: int) -> Column:
    """The n-th part (from 1) between slashes; empty if there are fewer."""
    return F.split_part(url, F.lit("/"), F.lit(n))


def path_text(path: Column, sep: str = ">") -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), sep)


def path_pairs(path: Column) -> Column:
    """Consecutive pairs of a path as array<struct<src,dst>>."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, F.lit(1), n - 1), F.slice(path, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))


def first_path_vertices(path_data: Column) -> Column:
    """Vertices of the first path of a JSON list of paths; 0 if there is none."""
    return F.coalesce(F.json_array_length(F.get_json_object(path_data, "$[0]")), F.lit(0))


def numbered_title(id_: Column, title: Column) -> Column:
    return F.format_string("%09d\t%s", id_, title)
