"""URL rules: host-suffix and path-prefix expressions matched by hash prefix.

Every URL is expanded into the expressions "host suffix + path prefix" that a
rule could have.  The expressions are equi-joined with the rules on the first
eight hex digits of their SHA-256, and the full digests confirm each match, so
a rule list can be shipped as short prefixes.  All of it is built-in
expressions.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; repeated rows each get a row; very long urls are taken whole; a
rule given twice counts once, and rules may have any number of shapes; of
rules that fit, the longest (host and path together) wins, then the longer
host, then ``block``.  Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
#: Rule lists up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_RULES = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path); the path starts with a slash."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def expressions(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """All "host suffix + path prefix" strings whose label count and path length are a shape of some rule."""
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    known = F.array(*[F.struct(F.lit(n).alias("labels"), F.array(*map(F.lit, lengths)).alias("lengths")) for n, lengths in sorted(shapes.items())])

    def of(shape: Column) -> Column:
        suffix = F.array_join(F.slice(labels, -shape["labels"], shape["labels"]), ".")
        return F.transform(F.filter(shape["lengths"], lambda n: n <= F.length(path)), lambda n: F.concat(suffix, F.substring(path, F.lit(1), n)))

    return F.flatten(F.transform(F.filter(known, lambda shape: shape["labels"] <= F.size(labels)), of))


def rule_shapes(rules: DataFrame) -> dict[int, list[int]]:
    """Path lengths of the rules (rule_host, rule_path) by the label count of their host.

    The driver gets distinct pairs of small numbers: at most the labels of the
    longest host times the length of the longest path, however many rules.
    """
    rows = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("length")).groupBy("labels").agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    return {r.labels: r.lengths for r in rows.collect()}


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """Judge the ``url`` of every row: (key, host, path, rule, verdict)."""
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).dropna().distinct()
    shapes = rule_shapes(rules)
    digests = rules.select(
        "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"),
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    if digests.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        digests = F.broadcast(digests)

    parsed = pages.select(key, "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # one expansion for each distinct url, so that a hot url costs one row a task
    expanded = (
        parsed.filter(F.col("host") != "").select("url", "host", "path").distinct()
        .select("url", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
        .select("url", F.sha2("expression", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))
    decided = (
        expanded.join(digests, "prefix").filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")
    )
    return parsed.join(decided, "url", "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
