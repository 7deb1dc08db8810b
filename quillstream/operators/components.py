"""Connected components and fixpoints over edge tables by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import keep


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node of its component.

    Rounds of large-star and small-star contraction: minima are aggregated before the shuffle and joined back, so hubs
    are never collected. Self-loops and null ends are left out; no edges give no nodes.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = keep(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = keep(small.where("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): the start nodes and all they lead to over the edges (parent, child): taint that spreads to descendants."""
    found = keep(start.select("node").where("node is not null").distinct())
    fresh = found
    while True:
        step = fresh.join(edges, fresh["node"] == edges["parent"]).select(F.col("child").alias("node")).where("node is not null").distinct()
        fresh = keep(step.join(found, "node", "left_anti"))
        if fresh.isEmpty():
            return found
        found = keep(found.unionByName(fresh))


def closed_under_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the greatest subset of the nodes that holds all parents of its members; parents that are no nodes drop a member."""
    kept = keep(nodes.select("node").where("node is not null").distinct())
    while True:
        parents = edges.select(F.col("parent").alias("p"), F.col("child").alias("node")).where("p is not null")
        lost = parents.join(kept.select(F.col("node").alias("p")), "p", "left_anti").select("node").distinct()
        drop = keep(kept.join(lost, "node", "left_semi"))
        if drop.isEmpty():
            return kept
        kept = keep(kept.join(drop, "node", "left_anti"))
