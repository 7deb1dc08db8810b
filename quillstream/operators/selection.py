"""Selections and set operations that hold for hot groups: tops per group, budgets, references, ranks, digests of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import keep

#: Parts a group is cut into before its best rows meet.
PARTS = 64


def set_digest(item: Column) -> Column:
    """An aggregate: a digest of the items whatever their order, as often as they occur; no list of them is made."""
    h = F.sha2(item, 256)
    sums = [F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16, 31, 46)]
    return F.sha2(F.concat_ws("|", *sums), 256)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], most: int, spread: Column, out: str = "place") -> DataFrame:
    """The first `most` rows of each group with their place, 1 first. Parts of a group (by a hash of `spread`) are cut to their
    own first rows before these meet, so a group of any size is fine. Null groups are a group."""
    part = Window.partitionBy(*group, F.pmod(F.xxhash64(spread), F.lit(PARTS))).orderBy(*order)
    near = df.withColumn(out, F.row_number().over(part)).where(F.col(out) <= most).drop(out)
    return near.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= most)


def within_budget(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """(group, order, used): the longest head of each group, in order, whose sizes fit a budget; sizes are 1 at least, so only
    the first `budget` rows can fit."""
    sized = df.select(group, order, F.greatest(size, F.lit(1)).alias("size"))
    head = top_per_group(sized, [group], [F.col(order)], budget, F.col(order))
    used = F.sum("size").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("used", used).where(F.col("used") <= budget).select(group, order, "used")


def referenced(df: DataFrame, key: str, row: str) -> DataFrame:
    """(key, first, row, repeated): each row with the first row of its key, which it is a repeated sighting of or is itself."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("first"))
    return df.join(first, key).select(key, "first", row, (F.col(row) != F.col("first")).alias("repeated"))


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """All rows with their rank in a total order, 1 first: sorted in ranges, numbered within each, moved up by the ranges before.
    The table is written once, as ranges must not change between counting and numbering."""
    sorted_ = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    kept = keep(sorted_)
    sizes = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return kept.withColumn(out, local).join(F.broadcast(before), "__range").withColumn(out, (F.col(out) + F.col("before")).cast("long")).drop("__range", "before")


def same_sets(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """(key, state): whether each key has the same set of items on both sides: equal, differs, left_only or right_only."""
    side = lambda df, name: df.where(F.col(key).isNotNull()).select(key, item).distinct().groupBy(key).agg(set_digest(F.coalesce(F.col(item).cast("string"), F.lit("\u0000"))).alias(name))
    both = side(left, "x").join(side(right, "y"), key, "full_outer")
    return both.select(key, F.when(F.col("y").isNull(), "left_only").when(F.col("x").isNull(), "right_only").when(F.col("x") == F.col("y"), "equal").otherwise("differs").alias("state"))


def support_of(uses: DataFrame, phrase: str, row: str, source: str, video: str, channel: str, at: str) -> DataFrame:
    """(phrase, rows, sources, videos, channels, first, last, support): the inverted index of phrases, by counts and a digest of the
    supporting rows, so that equal supports are told without lists."""
    u = uses.select(phrase, row, source, video, channel, at).distinct()
    once = u.groupBy(phrase, row).agg(F.min(source).alias("s"), F.min(video).alias("v"), F.min(channel).alias("c"), F.min(at).alias("a"))
    return once.groupBy(phrase).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("s").alias("sources"), F.count_distinct("v").alias("videos"), F.count_distinct("c").alias("channels"), F.min("a").alias("first"), F.max("a").alias("last"),
        set_digest(F.col(row)).alias("support"),
    )


def even_positions(n: Column, k: int) -> Column:
    """k evenly spaced indices of n items, first and last included, halves rounded to even; fewer where n is small."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(k - 1), 0).cast("long"))
    return F.when(n > 0, F.array_distinct(at)).otherwise(F.array().cast("array<bigint>"))
