"""Splits that keep related records together (problem 5).

Distributed union-find: every partition builds a forest of its edges and keeps only that; the forests are merged
hierarchically, in ever fewer partitions, while they fit a bound per task. Beyond the bound, rounds of large-star and
small-star joins contract what is left. Groups go to splits greedily, largest first, each to the split furthest below
its target; as only a group's size matters, that is worked out over the counts of groups of each size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.ranks import salted_rank
from quillstream.session import cut, small

#: Edges of forests that one task merges.
TASK_EDGES = 1_000_000
FAN_IN = 8
#: Groups of one size that are ranked in one task.
RANKED = 200_000
# Ids that name nothing.
PLACEHOLDERS = ("", "-", "n/a", "unknown")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (node, least node of its tree) of a forest with the same components as the partition's edges."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pd.DataFrame:
        rows = [(n, r) for n in parent if (r := root(n)) != n]
        parent.clear()
        return pd.DataFrame(rows, columns=["a", "b"])

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = root(a), root(b)
            if x != y:
                if y < x:
                    x, y = y, x
                parent[y] = x
        if len(parent) > 2 * TASK_EDGES:
            yield flush()
    yield flush()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (a, b) with b < a."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): each node of the edges (a, b), strings, with the least node of its component."""
    spark = edges.sparkSession
    forest = cut(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a <> b").mapInPandas(_forest, "a string, b string"))
    parts = max(1, forest.rdd.getNumPartitions())
    n = forest.count()
    while parts > 1 or n > task_edges:
        fewer = max((n + task_edges - 1) // task_edges, parts // FAN_IN, 1)
        merged = forest.repartition(fewer, "b")
        if fewer > 1:  # a hot root fills one task: contract by joins, which are split where skewed
            merged = _stars(forest).repartition(fewer, "b")
        merged = cut(merged.mapInPandas(_forest, "a string, b string"))
        before, n = n, merged.count()
        forest, parts = merged, fewer
        if fewer > 1 and n >= before and _is_star(forest):
            break
    roots = forest.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _is_star(edges: DataFrame) -> bool:
    """Every node has one root, and no root is a node of another."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return twice and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def clean(c: Column) -> Column:
    """An id without case and outer white space; null for ids that name nothing."""
    form = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(~form.isin(*PLACEHOLDERS), form)


def tied(records: DataFrame, entity: str, scalars: list[str], arrays: list[Column] = ()) -> DataFrame:
    """(entity, group): every entity with the least entity it is tied to, by any of its records' ids.

    Null and placeholder ids tie nothing; records without an entity are left out; repeated rows change nothing.
    """
    rows = records.select(clean(F.col(entity)).alias("e"), *[clean(F.col(c)).alias(f"s{i}") for i, c in enumerate(scalars)], *[x.alias(f"r{i}") for i, x in enumerate(arrays)]).where("e is not null")
    edges = None
    for i in range(len(scalars)):
        one = rows.where(f"s{i} is not null").select(F.concat(F.lit("0:"), "e").alias("a"), F.concat(F.lit(f"s{i}:"), f"s{i}").alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    for i in range(len(arrays)):
        each = rows.select("e", F.explode(f"r{i}").alias("x")).select("e", clean(F.col("x")).alias("x")).where("x is not null")
        one = each.select(F.concat(F.lit("0:"), "e").alias("a"), F.concat(F.lit(f"t{i}:"), "x").alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    labels = components(edges).where("node like '0:%'").select(F.substring("node", 3, 1 << 30).alias("e"), F.substring("root", 3, 1 << 30).alias("g"))
    return rows.select("e").distinct().join(labels, "e", "left").select(F.col("e").alias("entity"), F.coalesce("g", "e").alias("group"))


def allot(sizes: dict[int, int], targets: list[float]) -> dict[int, list[int]]:
    """How many groups of each size go to each split: largest first, each to the split furthest below its target.

    Only counts are needed: of m groups of one size, a split takes as many as keep its gap the widest. The m widest gaps
    of the sequences gap, gap - size, gap - 2 size, ... are found by bisection on the gap; ties go to the earlier split.
    """
    gaps = list(targets)
    out: dict[int, list[int]] = {}
    for size in sorted(sizes, reverse=True):
        m = sizes[size]
        lo, hi = min(gaps) - size * (m + 1), max(gaps)
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(max(0, int((g - mid) // size) + 1) for g in gaps) >= m:
                lo = mid
            else:
                hi = mid
        take = [max(0, int((g - hi) // size) + 1) for g in gaps]
        take = [min(t, m) for t in take]
        left = m - sum(take)
        now = [(-(g - t * size), i) for i, (g, t) in enumerate(zip(gaps, take))]
        heapq.heapify(now)
        while left > 0:
            _, i = heapq.heappop(now)
            take[i] += 1
            left -= 1
            heapq.heappush(now, (-(gaps[i] - take[i] * size), i))
        gaps = [g - t * size for g, t in zip(gaps, take)]
        out[size] = take
    return out


def assign(groups: DataFrame, splits: list[tuple[str, float]]) -> DataFrame:
    """(entity, group, split): all entities of a group in one split, the splits near their fractions of all entities.

    Distinct sizes of groups are collected: k different sizes need k (k + 1) / 2 entities at least, so they are few.
    """
    spark: SparkSession = groups.sparkSession
    sized = cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")))
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(s * n for s, n in counts.items())
    whole = sum(f for _, f in splits) or 1.0
    plan = allot(counts, [total * f / whole for _, f in splits])
    # each size's number of groups per split, one after the other: the rank of a group among those of its size names its split
    rows, names = [], [name for name, _ in splits]
    for size, take in plan.items():
        ends, at = [], 0
        for n in take:
            at += n
            ends.append(at)
        rows.append((size, ends))
    ends = small(spark.createDataFrame(rows, "size long, ends array<long>"), len(rows), 64 + 8 * len(names))
    ranked = salted_rank(sized, ["size"], F.col("group"), salts=max(64, sum(counts.values()) // RANKED + 1))
    which = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = ranked.join(ends, "size").select("group", F.element_at(F.array(*[F.lit(x) for x in names]), which + 1).alias("split"))
    return groups.join(placed, "group").select("entity", "group", "split")
