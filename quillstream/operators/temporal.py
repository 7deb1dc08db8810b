"""Point-in-time snapshots, partitions, exposure conflicts and rule checks of governed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators.components import connected


def latest_as_of(rows: DataFrame, key: Column, at: str, order: Column, available: str = "available_at", published: str = "published_at") -> DataFrame:
    """For each key, the row with the latest available_at of those available and, where it says so, published by `at`.

    Ties go to the row first in `order`. Rows with an unusable time or a null key are left out. The choice is one
    aggregate of a struct (combined before the shuffle), so a key of any size is fine.
    """
    when = F.lit(at).cast("timestamp")
    known, public = instant(available), instant(published)
    ok = (known <= when) & (F.col(published).isNull() | (public <= when))
    usable = rows.where(ok).withColumn("__k", key).where("__k is not null")
    best = usable.groupBy("__k").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(known.alias("t"), (-order).alias("o"))).alias("row"))
    return best.select("row.*")


def visible(items: Column, at: str) -> Column:
    """Of an array of structs, those available and published by `at`."""
    when = F.lit(at).cast("timestamp")
    return F.filter(items, lambda x: (instant(x["available_at"]) <= when) & (x["published_at"].isNull() | (instant(x["published_at"]) <= when)))


def partition_groups(nodes: DataFrame, edges: DataFrame, fractions: list[tuple[str, float]], seed: str, prior: DataFrame | None = None) -> DataFrame:
    """(node, group, split, conflict): one split per component: what its members ask for or had before, else by a seeded hash.

    nodes: (node, wanted), wanted null where a member asks for nothing. prior: (node, split), earlier assignments, which must
    not move. A component whose members ask for or had several splits is a conflict and gets no split.
    """
    labels = connected(edges)
    asked = nodes.select("node", "wanted")
    if prior is not None:
        asked = asked.unionByName(prior.select("node", F.col("split").alias("wanted")))
    grouped = asked.join(labels, "node", "left").select("node", "wanted", F.coalesce("root", "node").alias("group"))
    wishes = grouped.groupBy("group").agg(F.min("wanted").alias("low"), F.max("wanted").alias("high"))
    point, low, by_hash = T.split_point(seed, F.col("group")), 0.0, None
    total = sum(f for _, f in fractions)
    for name, fraction in fractions:
        low += fraction / total
        by_hash = F.when(point < low, name) if by_hash is None else by_hash.when(point < low, name)
    by_hash = by_hash.otherwise(fractions[-1][0])
    decided = wishes.select("group", (F.col("low") != F.col("high")).alias("conflict"), F.when(F.col("low").isNull(), by_hash).when(F.col("low") == F.col("high"), F.col("low")).alias("split"))
    return grouped.select("node", "group").distinct().join(decided, "group").select("node", "group", "split", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def exposure_conflicts(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(example_id, reason): current examples already exposed: the same entity and example, or the same brief and target.

    Two equi-joins instead of one join with OR; same_example_identity goes before same_content. Null ids or texts match
    nothing.
    """
    same_id = current.join(prior.select("entity", "example_id").where("entity is not null and example_id is not null").distinct(), ["entity", "example_id"], "left_semi").select("example_id", F.lit("same_example_identity").alias("reason"))
    key = ["brief_sha", "target_sha"]
    same_text = current.join(prior.select(*key).where("brief_sha is not null and target_sha is not null").distinct(), key, "left_semi").select("example_id", F.lit("same_content").alias("reason"))
    return same_id.unionByName(same_text).groupBy("example_id").agg(F.max("reason").alias("reason"))


def rule_breaks(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): every rule a row breaks; a null condition is not broken."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))
