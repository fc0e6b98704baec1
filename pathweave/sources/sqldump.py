"""SQL dump text (INSERT statements, gzipped or not) as typed tables, parsed on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.schema import DUMP_COLUMNS

#: A quoted string; possessive, so that statements of many megabytes do not exhaust the stack.
_STRING = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_TUPLE = rf"\((?:{_STRING}|[^'()])*+\)"
_VALUE = rf"{_STRING}|[^,'()\s]+"
_ESCAPES = [("\\0", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\Z", "\x1a"), ("\\'", "'"), ('\\"', '"')]


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(value, line): statements of a dump and their place in it. A gzip file is one split, so its statements are dealt out before parsing.

    ``line`` orders lines by file, split and place in the split.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", place.alias("line"))
    return lines.filter(F.col("value").startswith("INSERT ")).repartition(partitions or spark.sparkContext.defaultParallelism)


def _unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for escaped, char in _ESCAPES:
            part = F.replace(part, F.lit(escaped), F.lit(char))
        return part

    # an escaped backslash separates parts, so that what follows it is not taken for an escape
    return F.when(F.instr(text, "\\") > 0, F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")).otherwise(text)


def _value(raw: Column, kind: str) -> Column:
    if kind == "string":
        return F.when(raw.startswith("'"), _unescape(F.substring(raw, F.lit(2), F.length(raw) - 2)))
    if kind == "boolean":
        return raw.try_cast("int") != 0
    return raw.try_cast(kind)


def parse(lines: DataFrame, table: str) -> DataFrame:
    """Rows of the INSERT statements of ``table`` among ``lines``; other lines are skipped.

    Where the lines know their place, each row has an ``ordinal`` that orders it among all rows of the dump.
    """
    statements = lines.filter(F.col("value").startswith(f"INSERT INTO `{table}` "))
    placed = ["line"] if "line" in lines.columns else []
    tuples = statements.select(*placed, F.posexplode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(0))).alias("n", "t"))
    ordinal = [F.struct("line", "n").alias("ordinal")] if placed else []
    values = tuples.select(F.regexp_extract_all(F.substring("t", F.lit(2), F.length("t") - 2), F.lit(_VALUE), F.lit(0)).alias("v"), *ordinal)
    return typed(values, table)


def typed(values: DataFrame, table: str) -> DataFrame:
    """Raw values (array v) as the columns of ``table``; an ordinal passes."""
    return values.select(*[_value(F.get("v", F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(DUMP_COLUMNS[table])], *[c for c in values.columns if c == "ordinal"])


def _literal(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "string":
        text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit("NULL"))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def render(rows: DataFrame, table: str, rows_per_line: int = 100) -> DataFrame:
    """INSERT statements (column value) for ``rows``; missing columns are NULL."""
    columns = DUMP_COLUMNS[table]
    for name, kind in columns:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    tuples = rows.select(F.col(columns[0][0]).alias("k"), F.concat(F.lit("("), F.concat_ws(",", *[_literal(*c) for c in columns]), F.lit(")")).alias("t"))
    lines = tuples.groupBy(F.floor(F.col("k") / rows_per_line).alias("g")).agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("body"))
    return lines.select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), "body", F.lit(";")).alias("value"))
