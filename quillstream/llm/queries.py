"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import encode as enc
from quillstream.llm import garbled, groups, history, language, looks, overlap, pack, responses
from quillstream.llm.hdlang import Profiles
from quillstream.session import table


def bounded(df: DataFrame, most: int) -> list[tuple]:
    """All rows of a small table, in order; more than `most` are an error, as they would have to be left out."""
    rows = sorted(tuple(r) for r in df.limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is expected")
    return rows


def profiles(spark: SparkSession, d: str) -> Profiles:
    """Language profiles of the labelled samples (a small fixed table)."""
    return Profiles(bounded(table(spark, d, "language_samples").where("lang is not null and text is not null").select("lang", "text"), 20_000))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = history.repeated_rows(table(spark, d, "observations"))
    return found.select(F.col("repeated_line").alias("accepted_line"), F.col("line").alias("repeated_line"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = looks.same_look_pairs(table(spark, d, "video_cards"), "card_id", "video_id", ["title", "description"])
    return pairs.select(F.col("id_a").alias("card_id_a"), F.col("id_b").alias("card_id_b"), "field")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions in their consistent, case-folded form."""
    cards = table(spark, d, "video_cards")
    return cards.select("card_id", looks.canonical_column(F.col("title")).alias("title"), looks.canonical_column(F.col("description")).alias("description"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlap_pairs(table(spark, d, "creation_examples"), "example_id", "split", "source_id", ["brief", "target"])
    return pairs.select(F.col("id_a").alias("example_id_a"), F.col("id_b").alias("example_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps with train per evaluation split and source_id."""
    rows = overlap.overlap_report(table(spark, d, "creation_examples"), "example_id", "split", "source_id", ["brief", "target"])
    return rows.withColumnRenamed("source", "source_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return responses.judge(table(spark, d, "generation_responses"), profiles(spark, d))


def _ties(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "meme_records")
    return groups.tied(records, "meme_id", ["family_id"], [F.col("assets.source_group_id")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tied = _ties(spark, d)
    several = tied.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    return tied.join(several, "group").select(F.col("group").alias("group_id"), F.col("entity").alias("meme_id"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    """Every meme with its group and split."""
    splits = sorted(((name, float(part)) for name, part in bounded(table(spark, d, "split_fractions").select("split", "fraction"), 100)), key=lambda x: (-x[1], x[0]))
    return groups.assign(_ties(spark, d), splits).select(F.col("entity").alias("meme_id"), F.col("group").alias("group_id"), "split")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.relabelled(table(spark, d, "video_cards"), profiles(spark, d), "card_id", ["title", "description"], "default_language")
    return found.select(F.col("id").alias("card_id"), "lang")


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment."""
    rows = language.segment_languages(table(spark, d, "video_cards"), profiles(spark, d), "card_id", ["title", "description"])
    return rows.withColumnRenamed("id", "card_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where each text, or piece of a text larger than the capacity, goes, for each capacity."""
    capacities = [c for c, in bounded(table(spark, d, "context_windows").select("capacity").distinct(), 1000)]
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), enc.token_counts(F.col("text")).alias("size"))
    return pack.pack(items, capacities).withColumnRenamed("id", "doc_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return enc.encode(table(spark, d, "documents"), "doc_id", "text")


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled records with their chain and the restored text."""
    docs = table(spark, d, "documents")
    return garbled.repair(docs, garbled.fit(table(spark, d, "language_samples"), docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).select("doc_id").distinct()


_ID = "nullif(nullif(nullif(nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), ''), '-'), 'n/a'), 'unknown')"
_REACH = f"""tie AS (SELECT DISTINCT a, b FROM (SELECT '0:' || {_ID.format('meme_id')} AS a, '1:' || {_ID.format('family_id')} AS b FROM meme_records
    UNION ALL SELECT '0:' || {_ID.format('meme_id')}, '2:' || {_ID.format('x.source_group_id')} FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records)) WHERE a IS NOT NULL AND b IS NOT NULL),
  way AS (SELECT a AS x, b AS y FROM tie UNION SELECT b, a FROM tie),
  reach AS (SELECT DISTINCT '0:' || {_ID.format('meme_id')} AS s, '0:' || {_ID.format('meme_id')} AS n FROM meme_records WHERE {_ID.format('meme_id')} IS NOT NULL UNION SELECT reach.s, way.y FROM reach JOIN way ON reach.n = way.x),
  grp AS (SELECT substr(s, 3) AS meme_id, substr(min(n), 3) AS group_id FROM reach GROUP BY s)"""
SQL: dict[str, str] = {
    "p5_found": f"WITH RECURSIVE {_REACH} SELECT group_id, meme_id FROM grp WHERE group_id IN (SELECT group_id FROM grp GROUP BY group_id HAVING count(*) > 1)",
}


def queries():
    return {
        "p1_found": p1_found, "p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_report": p3_report,
        "p4_found": p4_found, "p5_found": p5_found, "p5_split": p5_split, "p6_found": p6_found, "p6_segments": p6_segments, "p8_ids": p8_ids,
        "p9_containers": p9_containers, "p10_found": p10_found, "p10_repaired": p10_repaired,
    }


def oracle_sql():
    return dict(SQL)
