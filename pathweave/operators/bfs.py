"""All shortest paths of many pairs at once: bidirectional search by levels, as DataFrame joins.

The driver holds the loop only.  Each round expands, for every open pair, the
side whose frontier has fewer edges to follow (ties: the backward side), drops
what that side has seen, keeps every parent of the same level, and looks for
vertices that both frontiers hold.  After i forward and j backward levels the
frontiers are the vertices at distance i from the source and j to the target,
so they first meet when i + j is the distance, and each shortest path crosses
the meeting set once.

The graph is a table of blocks, bucketed by slot: a level moves its frontier to
the blocks and never the blocks, and a frontier of few slots reads only their
buckets.  What a side has seen lies in buckets too, as runs that are merged by
tiers, and only the buckets that new vertices fall into are read.  So what a
level reads follows from its own size, not from the levels before it.

Levels are stored tables: lineage never grows and a lost executor costs one
level at most.  There is no limit on levels: a search ends when the frontiers
meet or one of them is empty.  Pairs are told apart by their two ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pathweave.operators import blocks
from pathweave.operators.blocks import Blocks, slot
from pathweave.plans.runs import Runs
from pathweave.plans.storage import Rounds, stored


def frontier_cost(frontier: DataFrame, degree: DataFrame) -> DataFrame:
    """(pair_id, f_cost, b_cost): out-degrees of the forward and in-degrees of the backward frontier (pair_id, side, v)."""
    cost = F.when(F.col("side") == "f", F.col("out_deg")).otherwise(F.col("in_deg"))
    return _costs(frontier.join(degree.withColumnRenamed("id", "v"), "v", "left").withColumn("links", F.coalesce(cost, F.lit(0))))


def _costs(frontier: DataFrame) -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("links")).otherwise(0))
    return frontier.groupBy("pair_id").agg(side("f").alias("f_cost"), side("b").alias("b_cost"))


class Search:
    """Result of a search: the parent log and where the frontiers met."""

    def __init__(self, pairs: DataFrame, log: DataFrame | None, meets: DataFrame | None, deepest: int):
        self.pairs, self.log, self.meets, self.deepest = pairs, log, meets, deepest


class Frontiers:
    """The stored frontiers of each round: (pair_id, side, v, f, b, parts, links, met), and how large the last one is."""

    def __init__(self, graph: Blocks, spark):
        self.graph, self.rounds = graph, Rounds(spark, "frontiers")
        self.vertexes = self.blocks = 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Store a round; its open vertices."""
        seen = Observation()
        open_ = ~F.col("met")
        counted = rows.observe(seen, F.coalesce(F.sum(F.when(open_, 1)), F.lit(0)).alias("vertexes"), F.coalesce(F.sum(F.when(open_, F.col("parts"))), F.lit(0)).alias("blocks"))
        now = self.rounds.add(counted).filter("not met").drop("met")
        self.vertexes, self.blocks = seen.get["vertexes"], seen.get["blocks"]
        return now

    def met(self) -> DataFrame:
        return self.rounds.all().filter("met").select("pair_id", "v", "f", "b")

    def steps(self, frontier: DataFrame) -> DataFrame:
        """(..., w): every neighbour of a frontier."""
        named = frontier.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("slot", slot(F.col("v"), F.col("side"), F.col("part")))
        slots = self.graph.few(named, self.blocks)
        return self.graph.joined(named, slots, "w").withColumn("w", F.explode("w"))

    def sized(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """``rows`` (side, v) with the blocks and links of each; vertices without links go, as no path goes on there."""
        named = rows.withColumn("slot", slot(F.col("v"), F.col("side"), F.lit(0)))
        slots = self.graph.few(named, n_rows)
        return self.graph.joined(named, slots, "parts", "links", how="left").drop("slot")


def ways_of(edges: DataFrame) -> Blocks:
    return blocks.build(edges)


def search(pairs: DataFrame, graph: DataFrame | Blocks) -> Search:
    """Search all (pair_id, source_id, target_id) in a graph, given as edges or blocks; pairs of equal ends need no graph."""
    spark = pairs.sparkSession
    pairs = stored(pairs.select("pair_id", "source_id", "target_id"), "pairs")
    open_ = pairs.filter("source_id <> target_id")
    n_open = open_.count()
    if not n_open:
        return Search(pairs, None, None, 0)
    graph = graph if isinstance(graph, Blocks) else ways_of(graph)
    seen, fronts = Runs(spark, "seen", ["pair_id", "side", "v"], graph.buckets), Frontiers(graph, spark)
    ends = F.array(F.struct(F.lit("f").alias("side"), F.col("source_id").alias("v")), F.struct(F.lit("b").alias("side"), F.col("target_id").alias("v")))
    first = open_.select("pair_id", F.explode(ends).alias("e")).select("pair_id", "e.side", "e.v")
    zero = F.lit(0)
    own = fronts.sized(first, 2 * n_open).withColumn("f", zero).withColumn("b", zero).withColumn("met", F.lit(False))
    # a pair one of whose ends has no links is not searched
    dead = own.filter("parts is null").select("pair_id")
    columns = ["pair_id", "side", "v", "f", "b", "parts", "links", "met"]
    frontier = fronts.add(own.join(dead, "pair_id", "left_anti").select(*columns))
    seen.extend(frontier.select("pair_id", "side", "v", F.lit(None).cast("bigint").alias("parent"), zero.alias("level"), "f", "b"))
    deepest = 0
    while fronts.vertexes:
        deepest += 1
        chosen = _costs(frontier).select("pair_id", F.when(F.col("f_cost") < F.col("b_cost"), "f").otherwise("b").alias("side"))
        count, at = Observation(), F.when(F.col("side") == "f", F.col("f")).otherwise(F.col("b"))
        near = fronts.steps(frontier.join(chosen, ["pair_id", "side"])).select("pair_id", "side", F.col("w").alias("v"), F.col("v").alias("parent"), (at + 1).alias("level"), "f", "b")
        # rows of vertices seen before are logged too, at a level that is not theirs: no path is traced through them
        grown = seen.extend(near.observe(count, F.count(F.lit(1)).alias("n")))
        moved = [F.when(F.col("side") == s, F.col(s) + 1).otherwise(F.col(s)).alias(s) for s in "fb"]
        reached = fronts.sized(grown.select("pair_id", "side", "v", *moved).distinct(), count.get["n"])
        facing = frontier.select("pair_id", F.col("side").alias("other"), "v")
        new = reached.join(facing, ["pair_id", "v"], "left").filter("other is null or side <> other").withColumn("met", F.col("other").isNotNull())
        new = stored(new.select(*columns), "new")
        # a pair whose side found nothing new is closed without a path, one whose frontiers met with its paths
        sides = new.groupBy("pair_id").agg(F.first("side").alias("moved"), F.max("f").alias("to_f"), F.max("b").alias("to_b"), F.max("met").alias("any_met"))
        closed = sides.filter("any_met").select("pair_id", F.lit(True).alias("closed"))
        going = new.filter("met or parts is not null").join(closed, "pair_id", "left").filter("met or closed is null")
        kept = frontier.drop("f", "b").join(sides.filter("not any_met"), "pair_id").filter(F.col("side") != F.col("moved")).select(
            "pair_id", "side", "v", F.col("to_f").alias("f"), F.col("to_b").alias("b"), "parts", "links", F.lit(False).alias("met"))
        frontier = fronts.add(going.select(*columns).unionByName(kept.select(*columns)))
    return Search(pairs, seen.all(), fronts.met(), deepest)


def _parents(found: Search, side: str) -> DataFrame:
    return found.log.filter((F.col("side") == side) & F.col("parent").isNotNull()).select("pair_id", F.col("v").alias("head"), "parent", "level")


def _trace(found: Search, side: str) -> DataFrame:
    """(pair_id, v, path): every way from a meeting vertex back to the side's end, which stands first for f and last for b."""
    rounds = Rounds(found.log.sparkSession, "ways")
    ways = rounds.add(found.meets.select("pair_id", "v", F.col(side).alias("left"), F.col("v").alias("head"), F.array("v").alias("path")))
    path = F.concat(F.array("parent"), "path") if side == "f" else F.concat("path", F.array("parent"))
    while not ways.filter("left > 0").isEmpty():
        ways = ways.filter("left > 0").join(_parents(found, side), ["pair_id", "head"]).filter(F.col("level") == F.col("left"))
        ways = rounds.add(ways.select("pair_id", "v", (F.col("left") - 1).alias("left"), F.col("parent").alias("head"), path.alias("path")))
    return rounds.all().filter("left = 0").select("pair_id", "v", "path")


def render(found: Search) -> DataFrame:
    """(pair_id, source_id, target_id, path) of every shortest path, ends included."""
    same = found.pairs.filter("source_id = target_id").select("pair_id", "source_id", "target_id", F.array("source_id").alias("path"))
    if found.meets is None or found.meets.isEmpty():
        return same
    ahead, back = _trace(found, "f"), _trace(found, "b")
    joined = ahead.join(back.withColumnRenamed("path", "tail"), ["pair_id", "v"]).select("pair_id", F.concat("path", F.slice("tail", F.lit(2), F.size("tail"))).alias("path"))
    return same.unionByName(found.pairs.join(joined, "pair_id").select("pair_id", "source_id", "target_id", "path"))


def _numbered(pairs: DataFrame) -> DataFrame:
    return pairs.select("source_id", "target_id").distinct().withColumn("pair_id", F.struct("source_id", "target_id"))


def shortest_paths(pairs: DataFrame, graph: DataFrame | Blocks) -> DataFrame:
    """(source_id, target_id, path) for pairs (source_id, target_id); a pair without a path has no row."""
    return render(search(_numbered(pairs), graph)).drop("pair_id")


def count_paths(pairs: DataFrame, graph: DataFrame | Blocks) -> DataFrame:
    """(source_id, target_id, degrees, n_paths) without listing paths, whose number may be exponential."""
    found = search(_numbered(pairs), graph)
    same = found.pairs.filter("source_id = target_id").select("source_id", "target_id", F.lit(0).alias("degrees"), F.lit(1).cast("decimal(38,0)").alias("n_paths"))
    if found.meets is None or found.meets.isEmpty():
        return same
    sides = {}
    for side in "fb":
        rounds = Rounds(found.log.sparkSession, "counts")
        ways = rounds.add(found.meets.select("pair_id", "v", F.col(side).alias("left"), F.col("v").alias("head"), F.lit(1).cast("decimal(38,0)").alias("n")))
        while not ways.filter("left > 0").isEmpty():
            ways = ways.filter("left > 0").join(_parents(found, side), ["pair_id", "head"]).filter(F.col("level") == F.col("left"))
            ways = rounds.add(ways.groupBy("pair_id", "v", (F.col("left") - 1).alias("left"), F.col("parent").alias("head")).agg(F.sum("n").cast("decimal(38,0)").alias("n")))
        sides[side] = rounds.all().filter("left = 0").groupBy("pair_id", "v").agg(F.sum("n").alias(f"n_{side}"))
    total = sides["f"].join(sides["b"], ["pair_id", "v"]).join(found.meets, ["pair_id", "v"]).groupBy("pair_id").agg(
        F.max(F.col("f") + F.col("b")).alias("degrees"), F.sum((F.col("n_f") * F.col("n_b")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("n_paths"))
    return same.unionByName(found.pairs.join(total, "pair_id").select("source_id", "target_id", "degrees", "n_paths"))
