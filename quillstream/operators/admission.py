"""Admission of observations: every row is eligible or has the first reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.session import keep

# Required fields in the order they are checked, and provenance classes.
REQUIRED = ("observation_id", "platform", "source_id", "video_id", "modality", "text")
TIMES = ("posted_at", "collected_at", "available_at", "updated_at")
PROVENANCE = ("actual_collected", "researcher_authored", "ai_synthetic")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule whose condition is true; null if none is. A null condition is not true."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for cond, reason in rules])


def row_reason(cutoff: str) -> Column:
    """The ladder of rules that look at one row; its instants are columns named __ and the time's name."""
    at = F.lit(cutoff).cast("timestamp")
    posted, collected, available, updated = (F.col(f"__{c}") for c in TIMES)
    has_update = F.col("updated_at").isNotNull() & (F.col("updated_at") != "")
    rules = [(F.col(c).isNull() | (F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == ""), f"missing_or_invalid_{c}") for c in REQUIRED]
    rules += [
        (F.lower("platform") != "youtube", "unsupported_platform"),
        (F.col("provenance").isNull() | ~F.col("provenance").isin(*PROVENANCE), "missing_or_invalid_provenance"),
    ]
    for name, when in (("posted_at", posted), ("collected_at", collected), ("available_at", available)):
        rules += [(when.isNull(), f"missing_or_invalid_{name}"), (when > at, f"{name}_after_cutoff")]
    rules += [
        (has_update & updated.isNull(), "invalid_updated_at"),
        (updated > at, "updated_at_after_cutoff"),
        (posted > collected, "posted_after_collection"),
        (updated > collected, "updated_after_collection"),
        (available < posted, "available_before_posted"),
        (F.col("normalized") == "", "empty_tokenized_text"),
    ]
    return first_reason(*rules)


def admit(rows: DataFrame, cutoff: str, line: str = "input_line") -> DataFrame:
    """rows with `normalized` and `reason` (null: eligible), in place of columns of these names.

    Among the rows that pass the row rules, the first of an id stands; later equal ones are duplicate_observation, later
    different ones conflicting_observation_id, and then the first is withdrawn for the same reason. Of what is left, the
    latest collected of each platform, source and modality stands (ties: greater id); others are
    superseded_source_snapshot. Nulls in any column lead to a reason; equal lines are told apart by content; an empty
    table gives an empty result. Ids and sources of any size are only aggregated and joined back, never windowed. The rows
    are written once; what compares them carries keys and digests only, and only lines with a reason are joined back.
    """
    columns = [c for c in rows.columns if c not in ("normalized", "reason")]
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != line]), {"ignoreNullFields": "false"}), 256)
    told = rows.withColumn("__content", F.unhex(content)).drop("normalized", "reason").withColumns({f"__{c}": instant(c) for c in TIMES})
    base = keep(told.withColumn("normalized", T.normalized(T.nfkc(F.col("text")))).withColumn("__r1", row_reason(cutoff)))
    passed = base.where("__r1 is null").select(
        F.col(line).alias("line"), F.col("observation_id").alias("id"), F.col("__content").alias("content"), F.lower("platform").alias("p"), F.col("source_id").alias("s"), F.col("modality").alias("m"), F.col("__collected_at").alias("at"),
    )
    several = passed.groupBy("id").agg(F.min(F.struct("line", "content")).alias("first"), F.min("content").alias("low"), F.max("content").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = passed.select("line", "id", "content").join(several, "id").select("line", first_reason(
        ((F.col("line") > F.col("first.line")) & (F.col("content") == F.col("first.content")), "duplicate_observation"), (F.col("low") != F.col("high"), "conflicting_observation_id"),
    ).alias("r")).where("r is not null")
    repeated = keep(repeated)
    left = passed.join(repeated, "line", "left_anti")
    newest = left.groupBy("p", "s", "m").agg(F.max(F.struct("at", "id")).alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    older = left.join(newest, ["p", "s", "m"]).where(F.col("id") != F.col("newest.id")).select("line", F.lit("superseded_source_snapshot").alias("r"))
    reasons = repeated.unionByName(older).groupBy(F.col("line").alias("__line")).agg(F.min("r").alias("__r"))  # a line given twice is joined once
    joined = base.join(reasons, (base[line] == F.col("__line")) & F.col("__r1").isNull(), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], "normalized", F.coalesce("__r1", "__r").alias("reason"))
