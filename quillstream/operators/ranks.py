"""Row numbers within a key that may hold most of the rows.

A window would collect a hot key into one task. Here every key is cut into salted pieces, pieces are numbered
on their own, and the sizes of the pieces (keys x salts rows, pre-aggregated) give each piece its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_rank(df: DataFrame, keys: list[str], order: Column, out: str = "rank", salts: int = 64) -> DataFrame:
    """Adds `out`, a dense 0-based number of the row within `keys`.

    `order` must be unique within a key; the numbering is deterministic (salt, then order) but is not the order
    itself. Null keys form one group. An empty input gives an empty result.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    within = salted.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(order)) - 1)
    on = [within[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__salt") == F.col("__s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = within.join(offsets, cond)
    return joined.withColumn(out, (F.col("__before") + F.col("__in")).cast("long")).select(*df.columns, out)
