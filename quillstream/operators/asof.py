"""Attributes as known at event time, by path-copied persistent search trees.

Each entity's records form a persistent tree: its roots are ordered by the time a record became known, its keys by
the time from which the record is valid. Inserting a record copies the path from the root to its key and leaves the
earlier roots as they were. An event takes the last root known at its time, then searches the keys valid by then.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut, small

#: An entity with more records than this is cut into blocks of time; with more events, its events are salted.
BLOCK_RECORDS = 200_000
SALT_EVENTS = 500_000
#: Stands for "valid from the beginning".
ALWAYS = -(2**62)


class PersistentTree:
    """A tree over a fixed sorted list of valid times. best[node] is the last-inserted (so latest-known) record below it."""

    def __init__(self, valid_times: list[int]):
        self.keys = valid_times
        self.left, self.right, self.best = [0], [0], [-1]
        self.roots: list[int] = []
        self.known: list[int] = []

    def _copy(self, node: int, record: int) -> int:
        self.left.append(self.left[node])
        self.right.append(self.right[node])
        self.best.append(record)
        return len(self.best) - 1

    def insert(self, known: int, valid: int, record: int) -> None:
        """Records must come in the order of `known`; the path to `valid` is copied, the rest is shared."""
        lo, hi = 0, len(self.keys) - 1
        at = bisect_right(self.keys, valid) - 1
        new = root = self._copy(self.roots[-1] if self.roots else 0, record)
        while lo < hi:
            mid = (lo + hi) // 2
            if at <= mid:
                self.left[new] = child = self._copy(self.left[new], record)
                hi = mid
            else:
                self.right[new] = child = self._copy(self.right[new], record)
                lo = mid + 1
            new = child
        self.known.append(known)
        self.roots.append(root)

    def search(self, at: int) -> int:
        """The latest-known record with known <= at and valid <= at, or -1."""
        version = bisect_right(self.known, at) - 1
        upto = bisect_right(self.keys, at) - 1
        if version < 0 or upto < 0:
            return -1
        node, lo, hi, found = self.roots[version], 0, len(self.keys) - 1, -1
        while node:
            if upto >= hi:
                return max(found, self.best[node])
            mid = (lo + hi) // 2
            if upto <= mid:
                node, hi = self.left[node], mid
            else:
                found = max(found, self.best[self.left[node]] if self.left[node] else -1)
                node, lo = self.right[node], mid + 1
        return found


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by entity, block and salt, records before events, records by known time."""
    entity, records, tree = None, [], None
    for pdf in batches:
        ids, values = [], []
        for key, block, salt, tag, known, valid, value, event in zip(
            pdf["k"], pdf["blk"], pdf["salt"], pdf["tag"], pdf["known"], pdf["valid"], pdf["value"], pdf["event"]
        ):
            if (key, block, salt) != entity:
                entity, records, tree = (key, block, salt), [], None
            if tag == 0:
                records.append((known, valid, value))
                continue
            if not records:
                continue
            if tree is None:
                tree = PersistentTree(sorted({r[1] for r in records}))
                for i, (kn, va, _) in enumerate(records):
                    tree.insert(kn, va, i)
            hit = tree.search(known)
            if hit >= 0:
                ids.append(event)
                values.append(records[hit][2])
        yield pd.DataFrame({"event": pd.Series(ids, dtype=object), "value": pd.Series(values, dtype=object)})


def _micros(c: Column) -> Column:
    return F.unix_micros(c)


def as_known_at(
    events: DataFrame,
    records: DataFrame,
    *,
    event_id: Column,
    event_key: Column,
    event_time: Column,
    record_key: Column,
    known_at: Column,
    valid_from: Column,
    value: Column,
    tie: Column | None = None,
    block_records: int = BLOCK_RECORDS,
    salt_events: int = SALT_EVENTS,
) -> DataFrame:
    """(event, value): for each event the value of its entity's latest-known record that was known and valid at the time.

    Times are timestamps. Events or records with a null key or a null time (known_at for records) take no part; a null
    valid_from means valid from the beginning. Events without a matching record are left out. Equal known times: the
    record with the greater `tie`, then the greater value, wins. Exact duplicates of events give one row; event_id and
    value are compared as strings. Empty tables give an empty result; extra columns are not read.

    Skew: records are deduplicated before the shuffle. An entity with more than block_records records is cut into
    blocks of effective time (the later of known and valid), each with the best earlier record carried in; an entity
    with more than salt_events events has them salted and its block of records repeated per salt.
    """
    rec = (
        records.select(
            record_key.cast("string").alias("k"),
            _micros(known_at).alias("known"),
            F.coalesce(_micros(valid_from), F.lit(ALWAYS)).alias("valid"),
            (tie if tie is not None else F.lit(0)).cast("double").alias("tie"),
            value.cast("string").alias("value"),
        )
        .where("k is not null and known is not null")
        .groupBy("k", "known", "valid")
        .agg(F.max(F.struct("tie", "value")).alias("m"))
        .select("k", "known", "valid", "m.tie", "m.value")
    )
    ev = (
        events.select(event_id.cast("string").alias("event"), event_key.cast("string").alias("k"), _micros(event_time).alias("at"))
        .where("event is not null and k is not null and at is not null")
        .distinct()
    )
    stats = (
        rec.groupBy("k").agg(F.count(F.lit(1)).alias("n_rec"), F.lit(0).cast("long").alias("n_ev"))
        .unionByName(ev.groupBy("k").agg(F.lit(0).cast("long").alias("n_rec"), F.count(F.lit(1)).alias("n_ev")))
        .groupBy("k").agg(F.sum("n_rec").alias("n_rec"), F.sum("n_ev").alias("n_ev"))
    )
    hot = cut(stats.where((F.col("n_rec") > block_records) | (F.col("n_ev") > salt_events)))
    n_hot = hot.count()
    if n_hot:
        rec, ev = _spread(rec, ev, hot, n_hot, block_records, salt_events)
    else:
        rec = rec.withColumns({"blk": F.lit(0), "salt": F.lit(0)})
        ev = ev.withColumns({"blk": F.lit(0), "salt": F.lit(0)})
    both = rec.select(
        "k", "blk", "salt", F.lit(0).alias("tag"), "known", "valid", "tie", "value", F.lit(None).cast("string").alias("event")
    ).unionByName(
        ev.select(
            "k", "blk", "salt", F.lit(1).alias("tag"), F.col("at").alias("known"), F.lit(0).cast("long").alias("valid"),
            F.lit(0.0).alias("tie"), F.lit(None).cast("string").alias("value"), "event",
        )
    )
    placed = both.repartition("k", "blk", "salt").sortWithinPartitions("k", "blk", "salt", "tag", "known", "tie", "value")
    return placed.mapInPandas(_probe, "event string, value string")


def _spread(rec: DataFrame, ev: DataFrame, hot: DataFrame, n_hot: int, block_records: int, salt_events: int):
    """Blocks of effective time for entities with many records, salts for those with many events."""
    effective = F.greatest("known", "valid")
    largest = hot.agg(F.max("n_rec")).first()[0] or 0
    parts = max(64, -(-int(largest) // block_records))  # cuts enough for the largest entity
    cuts = (
        rec.join(small(hot, n_hot, 60), "k")
        .groupBy("k")
        .agg(
            F.percentile_approx(effective, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q"),
            F.first("n_rec").alias("n_rec"),
        )
    )
    step = F.greatest(F.lit(1), (F.lit(parts) / F.ceil(F.col("n_rec") / block_records)).cast("int"))
    bounds = hot.join(cuts.drop("n_rec"), "k", "left").select(
        "k",
        F.when(
            F.col("n_rec") > block_records,
            F.array_distinct(F.filter(F.col("q"), lambda x, i: (i + 1) % step == 0)),
        ).otherwise(F.array().cast("array<bigint>")).alias("bounds"),
        F.greatest(F.lit(1), F.ceil(F.col("n_ev") / salt_events)).cast("int").alias("salts"),
    )
    bounds = cut(bounds)
    side = small(bounds, n_hot, 100 + 10 * parts)

    def block(x: str) -> Column:
        return F.coalesce(F.size(F.filter(F.col("bounds"), lambda b: b < F.col(x))), F.lit(0))

    placed = rec.withColumn("eff", effective).join(side, "k", "left").withColumn("blk", F.when(F.col("bounds").isNull(), 0).otherwise(block("eff")))
    best = placed.where("bounds is not null").groupBy("k", "blk").agg(F.max(F.struct("known", "tie", "value", "valid")).alias("m"), F.first("salts").alias("salts"))
    carry = (
        best.alias("a").join(bounds.select("k", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("b")), "k")
        .where(F.col("blk") < F.col("b"))
        .groupBy("k", "b").agg(F.max("m").alias("m"), F.first("salts").alias("salts"))
        .select("k", F.col("b").alias("blk"), "m.known", "m.valid", "m.tie", "m.value", "salts")
    )
    rec = placed.select("k", "blk", "known", "valid", "tie", "value", F.coalesce("salts", F.lit(1)).alias("salts")).unionByName(carry)
    rec = rec.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    ev = (
        ev.join(side, "k", "left")
        .withColumn("blk", F.when(F.col("bounds").isNull(), 0).otherwise(block("at")))
        .withColumn("salt", F.pmod(F.xxhash64("event"), F.coalesce("salts", F.lit(1))).cast("int"))
    )
    return rec, ev
