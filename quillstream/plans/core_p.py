"""Problem 7: each annotation with the version of its meme's record known and published at the annotation's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.times import ISO_OFFSET, instant
from quillstream.operators.asof import as_known_at
from quillstream.session import table


def clean_id(c):
    """Ids without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(annotation_id, version). Annotations or records with an unusable time or no meme take no part."""
    a = table(spark, d, "annotations").select("annotation_id", clean_id(F.col("meme_id")).alias("m"), instant("available_at").alias("t"))
    r = table(spark, d, "meme_records").select(
        clean_id(F.col("meme_id")).alias("m"), "version", instant("available_at").alias("known"),
        instant("published_at").alias("valid"), F.col("published_at").alias("raw"),
    ).where("raw is null or valid is not null")
    hits = as_known_at(
        a, r, event_id=F.col("annotation_id"), event_key=F.col("m"), event_time=F.col("t"), record_key=F.col("m"),
        known_at=F.col("known"), valid_from=F.col("valid"), value=F.col("version"), tie=F.expr("try_cast(version as double)"),
    )
    return hits.select(F.col("event").alias("annotation_id"), F.col("value").alias("version")).distinct()


def _ts(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{ISO_OFFSET}') THEN TRY_CAST({c} AS TIMESTAMPTZ) END"


SQL = {
    "p7_found": f"""
WITH r AS (
  SELECT lower(trim(meme_id, chr(32)||chr(9)||chr(10)||chr(13))) AS m, version, published_at,
         {_ts('available_at')} AS known, {_ts('published_at')} AS valid
  FROM meme_records),
a AS (
  SELECT DISTINCT annotation_id, lower(trim(meme_id, chr(32)||chr(9)||chr(10)||chr(13))) AS m,
         {_ts('available_at')} AS t
  FROM annotations),
c AS (
  SELECT a.annotation_id, a.t, a.m, r.version,
         row_number() OVER (PARTITION BY a.annotation_id, a.t, a.m
                            ORDER BY r.known DESC, TRY_CAST(r.version AS DOUBLE) DESC NULLS LAST, r.version DESC) AS n
  FROM a JOIN r ON a.m = r.m AND r.known <= a.t
       AND (r.published_at IS NULL OR r.valid <= a.t)
  WHERE a.t IS NOT NULL)
SELECT DISTINCT annotation_id, version FROM c WHERE n = 1"""
}


def queries():
    return {"p7_found": p7_found}


def oracle_sql():
    return dict(SQL)
