"""Filling fixed-capacity containers with items, never splitting one that fits (problem 9).

Harmonic packing: lengths fall into classes, class k holding those of which k but not k + 1 fit a container, and every
container of class k takes k items of the class, independently of the others. What such containers leave free is then
filled with items of later classes, the longest that fit first. As only lengths matter, all of it is planned over the
counts of each length (at most `capacity` numbers); workers place their items by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.ranks import salted_rank
from quillstream.session import keep

#: Items of one size and capacity that are ranked in one task.
RANKED = 200_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first container, items per container, containers): runs that place every item.

    counts: number of items of each length, 1 to capacity. Containers are numbered from 0. Each pattern is repeated until
    one of its lengths runs out, so the plan is as short as the list of lengths, times what a container holds.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    sizes = sorted(left, reverse=True)
    runs: list[tuple[int, int, int, int, int]] = []
    container = at = 0
    while at < len(sizes):
        if not left[sizes[at]]:
            at += 1
            continue
        k = capacity // sizes[at]
        pattern: dict[int, int] = {}
        room, need = capacity, k
        for s in sizes[at:]:  # k items of the class, longest first
            if need <= 0 or capacity // s != k:
                break
            take = min(need, left[s])
            if take:
                pattern[s] = take
                room -= take * s
                need -= take
        i = bisect_right(sizes, -room, lo=at, key=lambda s: -s - 1) if room else len(sizes)
        while room and i < len(sizes):  # the longest that fits what is left free
            s = sizes[i]
            if s <= room:
                take = min(room // s, left[s] - pattern.get(s, 0))
                if take > 0:
                    pattern[s] = pattern.get(s, 0) + take
                    room -= take * s
            i += 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            runs.append((s, used[s], container, n, times))
            used[s] += n * times
            left[s] -= n * times
        container += times
    return runs


def pack(items: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, container, id, piece, size) for items (id, size) and each capacity.

    An item longer than the capacity is cut into pieces, all but the last of full capacity; pieces are numbered from 0.
    Items of size 0 or null take no room and get a null container. Repeated ids are separate items.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    kind = dict(items.dtypes)["id"]
    pieces = (
        items.select("id", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
        .withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in caps])))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int")))))
        .select("id", "capacity", "piece", "row", F.least(F.col("n") - F.col("piece") * F.col("capacity"), F.col("capacity")).cast("int").alias("size"))
    )
    pieces = keep(pieces)
    counts: dict[int, dict[int, int]] = {c: {} for c in caps}
    for r in pieces.where("size > 0").groupBy("capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most sum(capacities) rows
        counts[r["capacity"]][r["size"]] = r["n"]
    runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for c in caps:
        for s, rank, container, n, _ in plan(counts[c], c):
            runs.setdefault((c, s), []).append((rank, container, n))
    starts = {key: [x[0] for x in value] for key, value in runs.items()}
    shared = items.sparkSession.sparkContext.broadcast((runs, starts))  # bounded by the capacities, not by the items

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, starts = shared.value
        for pdf in batches:
            out = []
            for c, s, rank in zip(pdf["capacity"], pdf["size"], pdf["rank"]):
                at = bisect_right(starts[c, s], rank) - 1
                first, container, n = runs[c, s][at]
                out.append(container + (rank - first) // n)
            yield pd.DataFrame({"capacity": pdf["capacity"], "container": pd.Series(out, dtype="int64"), "id": pdf["id"], "piece": pdf["piece"], "size": pdf["size"]})

    ranked = salted_rank(pieces.where("size > 0"), ["capacity", "size"], F.struct("row", "piece"), salts=max(64, max((n for c in counts.values() for n in c.values()), default=0) // RANKED + 1))
    schema = f"capacity int, container long, id {kind}, piece int, size int"
    placed = ranked.mapInPandas(place, schema)
    empty = pieces.where("size = 0").select("capacity", F.lit(None).cast("long").alias("container"), "id", "piece", "size")
    return placed.unionByName(empty)
