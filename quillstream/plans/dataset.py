"""Queries over governed records: snapshots, components, taint, partitions, checks, exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import components as C
from quillstream.operators import temporal as P
from quillstream.plans.core_p import _ts, clean_id
from quillstream.session import table

AT = "2024-03-01T00:00:00Z"
# Spellings of splits, and ids that name nothing.
SPLITS = {"training": "train", "train": "train", "val": "dev", "valid": "dev", "validation": "dev", "dev": "dev", "test": "test"}
NOTHING = ("", "-", "n/a", "unknown")


def split_of(c):
    return F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])[F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))]


def named(c):
    return F.when(~clean_id(c).isin(*NOTHING), clean_id(c))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meme_records")


def join_asof_latest(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_as_of(_records(spark, d), clean_id(F.col("meme_id")), AT, F.col("record_id")).select("meme_id", "version", "record_id")


def src_assets(spark: SparkSession, d: str) -> DataFrame:
    a = _records(spark, d).select("record_id", F.explode("assets").alias("a"))
    return a.groupBy("a.modality", "a.status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a.asset_id").alias("assets"))


def _ties(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select(named(F.col("meme_id")).alias("m"), named(F.col("family_id")).alias("f"), F.col("assets.source_group_id").alias("g")).where("m is not null")
    by_family = r.where("f is not null").select(F.concat(F.lit("0"), "m").alias("a"), F.concat(F.lit("1"), "f").alias("b"))
    groups = r.select("m", F.explode("g").alias("g")).select("m", named(F.col("g")).alias("g")).where("g is not null")
    return by_family.unionByName(groups.select(F.concat(F.lit("0"), "m").alias("a"), F.concat(F.lit("2"), "g").alias("b"))).distinct()


def _parents(spark: SparkSession, d: str) -> DataFrame:
    a = _records(spark, d).select(F.explode("assets").alias("a")).select(clean_id(F.col("a.asset_id")).alias("child"), F.explode("a.parent_asset_ids").alias("p"))
    return a.select(clean_id(F.col("p")).alias("parent"), "child").where("parent is not null and child is not null").distinct()


def gr_parent_closure(spark: SparkSession, d: str) -> DataFrame:
    """Assets with status ok all of whose ancestors are known and ok."""
    ok = _records(spark, d).select(F.explode("assets").alias("a")).where("a.status = 'ok'").select(clean_id(F.col("a.asset_id")).alias("node"))
    return C.closed_under_parents(ok, _parents(spark, d)).select(F.col("node").alias("asset_id"))


def agg_provenance(spark: SparkSession, d: str) -> DataFrame:
    by = _records(spark, d).groupBy("meme_id").agg(F.min("provenance").alias("a"), F.max("provenance").alias("b"))
    return by.select("meme_id", F.when(F.col("a").isNull(), "not_applicable").when(F.col("a") != F.col("b"), "mixed").otherwise(F.col("a")).alias("provenance"))


def fn_split_point(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("meme_id is not null").select("meme_id").distinct().select("meme_id", F.round(T.split_point("seed-1", F.col("meme_id")), 12).alias("point"))


def sx_unique_key(spark: SparkSession, d: str) -> DataFrame:
    """(meme, version) keys that several rows hold."""
    return _records(spark, d).groupBy("meme_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tm_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Dev and test examples already exposed by earlier train examples, by identity or by content."""
    dense = lambda c: F.sha2(F.lower(F.regexp_replace(c, r"[ \n\t]+", "")), 256)
    e = table(spark, d, "creation_examples").select(
        F.col("meme_id").alias("entity"), F.col("example_id"), split_of(F.col("split")).alias("s"), dense("brief").alias("brief_sha"), dense("target").alias("target_sha"),
    )
    prior = e.where("s = 'train'").select("entity", "example_id", "brief_sha", "target_sha")
    current = e.where("s in ('dev', 'test')").select("entity", "example_id", "brief_sha", "target_sha")
    return P.exposure_conflicts(current, prior)


def set_split_diff(spark: SparkSession, d: str) -> DataFrame:
    """Memes with annotations but no record, and the other way round."""
    a = table(spark, d, "annotations").select(clean_id(F.col("meme_id")).alias("m")).where("m is not null").distinct()
    r = _records(spark, d).select(clean_id(F.col("meme_id")).alias("m")).where("m is not null").distinct()
    return a.subtract(r).select("m", F.lit("no_record").alias("side")).unionByName(r.subtract(a).select("m", F.lit("no_annotation").alias("side")))


def sx_author_rule(spark: SparkSession, d: str) -> DataFrame:
    """Per author type: annotations, and those that claim human minutes though no human wrote them."""
    minutes = F.coalesce((F.col("human_minutes") > 0) & ~F.isnan("human_minutes"), F.lit(False))
    other = F.col("author.type").isNull() | (F.col("author.type") != "human")
    return table(spark, d, "annotations").groupBy(F.col("author.type").alias("type")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(minutes & other).alias("broken"), F.count_if(minutes).alias("claimed"))


def set_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    """The last of each annotation's rows, by ingestion."""
    a = table(spark, d, "annotations")
    return a.groupBy("annotation_id").agg(F.max(F.struct("ingested_at", F.coalesce("role", F.lit("")).alias("role"))).alias("x")).select("annotation_id", "x.role")


_SPLIT = "CASE lower(trim({0}, ' ' || chr(9) || chr(10))) WHEN 'training' THEN 'train' WHEN 'train' THEN 'train' WHEN 'val' THEN 'dev' WHEN 'valid' THEN 'dev' WHEN 'validation' THEN 'dev' WHEN 'dev' THEN 'dev' WHEN 'test' THEN 'test' END"
_ID = "lower(trim({0}, ' ' || chr(9) || chr(10)))"
_LATEST = f"""WITH r AS (SELECT *, {_ts('available_at')} AS k, {_ts('published_at')} AS p FROM meme_records),
l AS (SELECT *, row_number() OVER (PARTITION BY {_ID.format('meme_id')} ORDER BY k DESC, record_id) AS n FROM r
  WHERE meme_id IS NOT NULL AND k <= TIMESTAMPTZ '{AT}' AND (published_at IS NULL OR p <= TIMESTAMPTZ '{AT}'))
"""
_TIES = f"""t AS (SELECT DISTINCT {_ID.format('meme_id')} AS m, '1' || {_ID.format('family_id')} AS g FROM meme_records WHERE meme_id IS NOT NULL AND {_ID.format('family_id')} NOT IN ('', '-', 'n/a', 'unknown')
  UNION SELECT DISTINCT m, '2' || {_ID.format('s')} FROM (SELECT {_ID.format('meme_id')} AS m, unnest(assets).source_group_id AS s FROM meme_records WHERE meme_id IS NOT NULL) WHERE {_ID.format('s')} NOT IN ('', '-', 'n/a', 'unknown'))"""
_EDGES = f"""e AS (SELECT DISTINCT {_ID.format('c')} AS child, {_ID.format('p')} AS parent FROM (SELECT a.asset_id AS c, unnest(a.parent_asset_ids) AS p FROM (SELECT unnest(assets) AS a FROM meme_records)) WHERE c IS NOT NULL AND p IS NOT NULL)"""

SQL = {
    "join_asof_latest": _LATEST + "SELECT meme_id, version, record_id FROM l WHERE n = 1",
    "src_assets": "SELECT a.modality AS modality, a.status AS status, count(*) AS n, count(DISTINCT a.asset_id) AS assets FROM (SELECT unnest(assets) AS a FROM meme_records) GROUP BY 1, 2",
    "gr_parent_closure": f"""WITH RECURSIVE {_EDGES}, o AS (SELECT DISTINCT {_ID.format('a.asset_id')} AS node FROM (SELECT unnest(assets) AS a FROM meme_records) WHERE a.status = 'ok' AND a.asset_id IS NOT NULL),
      lost AS (SELECT child AS node FROM e WHERE parent NOT IN (SELECT node FROM o) UNION SELECT e.child FROM lost JOIN e ON e.parent = lost.node)
      SELECT node AS asset_id FROM o WHERE node NOT IN (SELECT node FROM lost)""",
    "agg_provenance": "SELECT meme_id, CASE WHEN min(provenance) IS NULL THEN 'not_applicable' WHEN min(provenance) <> max(provenance) THEN 'mixed' ELSE min(provenance) END AS provenance FROM meme_records GROUP BY meme_id",
    "fn_split_point": "SELECT meme_id, round(('0x' || substr(sha256('seed-1|' || meme_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 12) AS point FROM (SELECT DISTINCT meme_id FROM meme_records WHERE meme_id IS NOT NULL)",
    "sx_unique_key": "SELECT meme_id, version, count(*) AS n FROM meme_records GROUP BY meme_id, version HAVING count(*) > 1",
    "tm_exposure": f"""WITH e AS (SELECT example_id, meme_id, {_SPLIT.format('split')} AS s, sha256(lower(regexp_replace(brief, '[ \\n\\t]+', '', 'g'))) AS b, sha256(lower(regexp_replace(target, '[ \\n\\t]+', '', 'g'))) AS t FROM creation_examples),
      tr AS (SELECT * FROM e WHERE s = 'train'), ev AS (SELECT * FROM e WHERE s IN ('dev', 'test'))
      SELECT example_id, CASE WHEN EXISTS (SELECT 1 FROM tr WHERE tr.meme_id = ev.meme_id AND tr.example_id = ev.example_id) THEN 'same_example_identity' ELSE 'same_content' END AS reason FROM ev
      WHERE EXISTS (SELECT 1 FROM tr WHERE tr.b = ev.b AND tr.t = ev.t) OR EXISTS (SELECT 1 FROM tr WHERE tr.meme_id = ev.meme_id AND tr.example_id = ev.example_id)""",
    "set_split_diff": f"""WITH a AS (SELECT DISTINCT {_ID.format('meme_id')} AS m FROM annotations WHERE meme_id IS NOT NULL), r AS (SELECT DISTINCT {_ID.format('meme_id')} AS m FROM meme_records WHERE meme_id IS NOT NULL)
      SELECT m, 'no_record' AS side FROM (SELECT m FROM a EXCEPT SELECT m FROM r) UNION ALL SELECT m, 'no_annotation' FROM (SELECT m FROM r EXCEPT SELECT m FROM a)""",
    "sx_author_rule": "SELECT author.type AS type, count(*) AS rows, count(*) FILTER (WHERE human_minutes > 0 AND NOT isnan(human_minutes) AND (author.type IS NULL OR author.type <> 'human')) AS broken, count(*) FILTER (WHERE human_minutes > 0 AND NOT isnan(human_minutes)) AS claimed FROM annotations GROUP BY 1",
    "set_dedupe_last": "SELECT annotation_id, role FROM (SELECT annotation_id, coalesce(role, '') AS role, row_number() OVER (PARTITION BY annotation_id ORDER BY ingested_at DESC NULLS LAST, coalesce(role, '') DESC) AS n FROM annotations) WHERE n = 1",
}


def queries():
    return {f.__name__: f for f in (
        join_asof_latest, src_assets, gr_parent_closure, agg_provenance, fn_split_point, sx_unique_key,
        tm_exposure, set_split_diff, sx_author_rule, set_dedupe_last,
    )}


def oracle_sql():
    return dict(SQL)
