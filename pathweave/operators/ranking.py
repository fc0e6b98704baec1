"""Ranks of a whole table without one task that sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.plans import storage


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with a column ``name``: 1, 2, ... without gaps in ascending ``order`` (nulls first).

    Rows are dealt to ranges of the order, numbered within each, and moved on by
    the rows of the ranges before it; the driver sees one count for each range.
    Rows that ``order`` does not tell apart are numbered in any order, and all of
    them lie in one range: name enough columns.
    """
    part = "_range"
    while part in rows.columns:
        part += "_"
    # a row's range is fixed by storing it
    dealt = storage.stored(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in dealt.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        before.append((r[part], total))
        total += r.n
    offsets = rows.sparkSession.createDataFrame(before, f"{part} int, _before bigint")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    number = (own + F.col("_before")).cast("int" if total < 2**31 else "bigint")
    # a row for each range
    return dealt.join(F.broadcast(offsets), part).withColumn(name, number).drop(part, "_before")
