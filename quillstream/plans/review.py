"""Queries of review, lookup, bundles, permissions, sampling and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import review as R
from quillstream.operators import seeds as S
from quillstream.session import keep, table


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return keep(S.unique_videos(table(spark, d, "video_cards"), "card_id"))


def op_title_variations(spark: SparkSession, d: str) -> DataFrame:
    return R.title_variations(_videos(spark, d).select(F.col("card_id").alias("id"), "video_id", "title"))


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """The fifty frames of most videos, as candidates."""
    top = R.shared_frames(table(spark, d, "video_cards"), 3, 3).orderBy(F.desc("videos"), "frame").limit(50)
    return keep(top.select(T.hash_id("c_", F.col("frame")).alias("candidate_id"), F.col("frame").alias("phrase"), F.lit(False).alias("only_tags")))


def op_review(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "video_cards")
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("raw")), F.struct(F.lit("description").alias("field"), F.col("description").alias("raw")))
    lines = cards.select("video_id", F.explode(fields).alias("f")).where("f.raw is not null").select("video_id", "f.field", F.explode(F.split("f.raw", "\n")).alias("raw"))
    return R.review(_phrases(spark, d), lines.withColumn("normalized", T.normalized(F.col("raw"))))


def op_identify(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold any shared title frame, or the expression or comparison frame of any seed."""
    frames = R.shared_frames(table(spark, d, "video_cards"), 3, 3).select(T.hash_id("c_", F.col("frame")).alias("family_id"), F.col("frame").alias("label"), F.lit("literal").alias("kind"))
    seeds = S.plan_seeds(_videos(spark, d), None).select(F.col("seed_id").alias("family_id"), F.col("query").alias("label"), "kind")
    families = frames.unionByName(seeds).withColumn("available_at", F.lit("2024-01-01T00:00:00Z"))
    return R.identify(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), families, "2024-06-01T00:00:00Z")


def sample_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Blind order of each case's responses: a seeded hash decides, and shows nothing of the condition."""
    r = table(spark, d, "generation_responses").where("case_id is not null").dropDuplicates(["response_id"])
    w = Window.partitionBy("case_id").orderBy(F.sha2(F.concat(F.lit("seed|"), "response_id"), 256))
    return r.select("case_id", "response_id", F.row_number().over(w).alias("place"))


def fn_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_responses").where("output is not null").select("response_id", F.sha2(T.html_escape(F.col("output")), 256).alias("sha")).distinct()


SQL = {
    "sample_shuffle": """WITH r AS (SELECT DISTINCT case_id, response_id FROM generation_responses WHERE case_id IS NOT NULL)
      SELECT case_id, response_id, (row_number() OVER (PARTITION BY case_id ORDER BY sha256('seed|' || response_id)))::INT AS place FROM r""",
    "fn_html_escape": """SELECT DISTINCT response_id, sha256(replace(replace(replace(replace(replace(output, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS sha FROM generation_responses WHERE output IS NOT NULL""",
}


def queries():
    return {f.__name__: f for f in (
        op_title_variations, op_review, op_identify, sample_shuffle, fn_html_escape,
    )}


def oracle_sql():
    return dict(SQL)
