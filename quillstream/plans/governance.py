"""Queries over governed records, with their SQL: snapshots, export, support and evaluation, ties, rules, lineage, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.times import instant
from quillstream.operators import components as C
from quillstream.operators import governance as G
from quillstream.operators import temporal as P
from quillstream.operators.review import allowed
from quillstream.plans.core_p import _ts, clean_id
from quillstream.plans.dataset import _ID, _LATEST, _SPLIT, AT, named, split_of
from quillstream.session import table

#: Times of support and of evaluation.
SUPPORT_AT, EVALUATE_AT = "2024-03-01T00:00:00Z", "2024-05-01T00:00:00Z"
FRACTIONS = [("train", 0.72), ("dev", 0.13), ("test", 0.15)]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meme_records")


def _snapshot(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    keyed = lambda name: table(spark, d, name).withColumn("key", clean_id(F.col("meme_id")))
    return G.snapshot(_records(spark, d), keyed("annotations"), keyed("creation_examples"), clean_id(F.col("meme_id")), AT, F.col("record_id"))


def tm_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Each meme known at a time with the assets, relations, annotations and examples that hang on it by then."""
    return G.counted_by(_snapshot(spark, d))


def tm_snapshot_export(spark: SparkSession, d: str) -> DataFrame:
    """Where the texts of the snapshot's examples go."""
    return G.routed(_snapshot(spark, d)["examples"], split_of(F.col("split")))


def tm_two_axis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "creation_examples").select(clean_id(F.col("meme_id")).alias("key"), "example_id", split_of(F.col("split")).alias("split"), "brief", "target", "available_at")
    known = P.latest_as_of(_records(spark, d), clean_id(F.col("meme_id")), SUPPORT_AT, F.col("record_id")).select(clean_id(F.col("meme_id")).alias("key"))
    return G.two_axis(e, known, SUPPORT_AT, EVALUATE_AT)


def _ties(spark: SparkSession, d: str) -> DataFrame:
    return G.tie_edges(_records(spark, d), named(F.col("meme_id")), named)


def gr_cc_split(spark: SparkSession, d: str) -> DataFrame:
    """Components of memes by all kinds of ties, each by its least meme."""
    found = C.connected(_ties(spark, d)).where("node like '0:%'")
    return found.select(F.substring("node", 3, 1 << 20).alias("meme_id"), F.substring("root", 3, 1 << 20).alias("group_id"))


def gr_partition(spark: SparkSession, d: str) -> DataFrame:
    """Split per component of family and source-group ties: an earlier assignment goes first, then what its members ask for, then
    a seeded hash; contradictions are conflicts. The earlier assignments are those of the first versions."""
    r = _records(spark, d).select(F.concat(F.lit("0:"), named(F.col("meme_id"))).alias("node"), split_of(F.col("split")).alias("wanted"), "version").where("node is not null")
    prior = r.where("version = '1' and wanted is not null").select("node", F.col("wanted").alias("split")).distinct()
    edges = _ties(spark, d).where("a like '0:%' and (b like '1:%' or b like '2:%')")
    out = P.partition_groups(r.select("node", "wanted").distinct(), edges, FRACTIONS, "seed-1", prior)
    return out.select(F.substring("node", 3, 1 << 20).alias("meme_id"), F.substring("group", 3, 1 << 20).alias("group_id"), "split", "conflict").distinct()


def sx_family_partition(spark: SparkSession, d: str) -> DataFrame:
    """Families of the examples, split by a seeded hash of their component; the examples' own splits don't count."""
    e = table(spark, d, "creation_examples").select(named(F.col("family_id")).alias("f"), named(F.col("source_group_id")).alias("g")).where("f is not null")
    edges = e.where("g is not null").select(F.concat(F.lit("0:"), "f").alias("a"), F.concat(F.lit("1:"), "g").alias("b")).distinct()
    nodes = e.select(F.concat(F.lit("0:"), "f").alias("node"), F.lit(None).cast("string").alias("wanted")).distinct()
    out = P.partition_groups(nodes, edges, FRACTIONS, "seed-2")
    return out.select(F.substring("node", 3, 1 << 20).alias("family_id"), "split")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", split_of(F.col("split")).alias("s"), F.explode("assets").alias("a")).select("record_id", "s", clean_id(F.col("a.asset_id")).alias("asset_id"), F.trim("a.source_url").alias("content"), F.col("a.parent_asset_ids").alias("parents"), F.col("a.status").alias("status"), F.col("a.license_or_use_basis").alias("license"))


def gr_taint(spark: SparkSession, d: str) -> DataFrame:
    """Assets of dev and test records, all of the same content, and everything derived from either."""
    a = _assets(spark, d)
    parents = a.select(F.col("asset_id").alias("child"), F.explode("parents").alias("p")).select(clean_id(F.col("p")).alias("parent"), "child").where("parent is not null and child is not null")
    held = a.where("s in ('dev', 'test')").select(F.col("asset_id").alias("node"))
    found = C.reachable(parents.unionByName(G.content_edges(a)).distinct(), held)
    return found.where("node not like 'content:%'").select(F.col("node").alias("asset_id"))


def tm_permission(spark: SparkSession, d: str) -> DataFrame:
    """Assets allowed for retrieval and training, by licence and status, where later records override earlier ones."""
    a = _assets(spark, d).where("asset_id is not null")
    given = a.select("asset_id", F.col("license").isNotNull().alias("retrieval"), (F.col("status") == "ok").alias("training"))
    over = a.where("s = 'test'").groupBy("asset_id").agg(F.max("record_id").alias("r")).select("asset_id", F.when(F.col("r") % 2 == 0, False).alias("retrieval"), F.lit(None).cast("boolean").alias("training"))
    return allowed(given, over)


def flt_validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Rules of records, by how many break them."""
    return P.rule_breaks(_records(spark, d), "record_id", G.record_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def tm_merge_ingest(spark: SparkSession, d: str) -> DataFrame:
    """What keeps records from being taken in together."""
    return G.across_records(_records(spark, d), clean_id(F.col("meme_id")))


def flt_validate_dataset(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "creation_examples").select("family_id", "source_group_id", F.col("target").alias("text"), split_of(F.col("split")).alias("split"))
    return G.split_leaks(e)


def join_lineage_verify(spark: SparkSession, d: str) -> DataFrame:
    return G.asset_lineage(_records(spark, d), named)


def join_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Assets of collected records against those of the other records as a manifest, by place and licence."""
    a = _records(spark, d).select("provenance", F.explode("assets").alias("a")).select("provenance", F.col("a.source_url").alias("path"), F.concat_ws("|", "a.modality", "a.status").alias("digest"))
    return G.against_manifest(a.where("provenance = 'actual_collected'"), a.where("provenance <> 'actual_collected'"), ("path", "digest"))


def join_left_missing(spark: SparkSession, d: str) -> DataFrame:
    """Annotations by whether a record of their meme is there, excluded (known too late) or missing."""
    a = table(spark, d, "annotations").select("annotation_id", clean_id(F.col("meme_id")).alias("m")).distinct()
    r = _records(spark, d).select(clean_id(F.col("meme_id")).alias("m"), G.visible_by(AT, published="published_at").alias("ok")).where("m is not null").groupBy("m").agg(F.max("ok").alias("ok"))
    return a.join(r, "m", "left").select("annotation_id", F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "there").otherwise("excluded").alias("state"))


def tm_backdate_guard(spark: SparkSession, d: str) -> DataFrame:
    """Annotations dated before the first record they can be about."""
    first = _records(spark, d).select(clean_id(F.col("meme_id")).alias("m"), instant("available_at").alias("t")).groupBy("m").agg(F.min("t").alias("first"))
    a = table(spark, d, "annotations").select("annotation_id", clean_id(F.col("meme_id")).alias("m"), instant("available_at").alias("t"))
    return a.join(first, "m").where("t < first").select("annotation_id").distinct()


def flt_knowledge(spark: SparkSession, d: str) -> DataFrame:
    out = G.admissible_knowledge(table(spark, d, "annotations"), AT)
    return out.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flt_examples(spark: SparkSession, d: str) -> DataFrame:
    """Two examples of each family at most, with excerpts of 60 letters, and why others are left out."""
    out = G.selected_examples(table(spark, d, "creation_examples"), "family_id", "example_id", AT, 2, 60, "target")
    return out.select(F.col("grp").alias("family_id"), F.col("key").alias("example_id"), "reason", "excerpt", "cut_letters")


def flt_raw_obs(spark: SparkSession, d: str) -> DataFrame:
    out = G.raw_admitted(table(spark, d, "observations"), "2024-01-05T00:00:00Z")
    return out.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flt_window(spark: SparkSession, d: str) -> DataFrame:
    """Observations published in a half-open window, per day."""
    at = instant("posted_at")
    inside = table(spark, d, "observations").where((at >= F.lit("2023-12-01T00:00:00Z").cast("timestamp")) & (at < F.lit("2024-01-01T00:00:00Z").cast("timestamp")))
    return inside.groupBy(F.to_date(at).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def set_subset(spark: SparkSession, d: str) -> DataFrame:
    """Records all of whose assets' parents are among the record's own assets."""
    own, parents = F.transform("assets", lambda a: a["asset_id"]), F.flatten(F.transform("assets", lambda a: a["parent_asset_ids"]))
    return _records(spark, d).select("record_id", (F.size(F.array_except(parents, own)) == 0).alias("closed"))


_NAMED = "nullif(nullif(nullif(nullif(" + _ID + ", ''), '-'), 'n/a'), 'unknown')"
_EDGES = f"""tie AS (SELECT DISTINCT '0:' || m AS a, b FROM (
    SELECT {_NAMED.format('meme_id')} AS m, '1:' || {_NAMED.format('family_id')} AS b FROM meme_records
    UNION ALL SELECT {_NAMED.format('meme_id')}, '2:' || {_NAMED.format('x.source_group_id')} FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records)) WHERE m IS NOT NULL AND b IS NOT NULL)"""
_ALL_EDGES = f"""tie AS (SELECT DISTINCT a, b FROM (
    SELECT '0:' || {_NAMED.format('meme_id')} AS a, '1:' || {_NAMED.format('family_id')} AS b FROM meme_records
    UNION ALL SELECT '0:' || {_NAMED.format('meme_id')}, '2:' || {_NAMED.format('x.source_group_id')} FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records)
    UNION ALL SELECT '0:' || {_NAMED.format('meme_id')}, '3:' || {_NAMED.format('x.asset_id')} FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records)
    UNION ALL SELECT '0:' || {_NAMED.format('meme_id')}, '4:' || nullif(trim(x.source_url), '') FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records)
    UNION ALL SELECT '3:' || {_NAMED.format('c')}, '3:' || {_NAMED.format('p')} FROM (SELECT x.asset_id AS c, unnest(x.parent_asset_ids) AS p FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records WHERE {_NAMED.format('meme_id')} IS NOT NULL))
    ) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"""
_REACH = """way AS (SELECT a AS x, b AS y FROM tie UNION SELECT b, a FROM tie), reach AS (SELECT DISTINCT a AS s, a AS n FROM tie WHERE a LIKE '0:%' UNION SELECT reach.s, way.y FROM reach JOIN way ON reach.n = way.x),
    grp AS (SELECT s, min(n) AS g FROM reach GROUP BY s)"""
_POINT = "('0x' || substr(sha256('{1}|' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_BY_HASH = "CASE WHEN {0} < 0.72 THEN 'train' WHEN {0} < 0.85 THEN 'dev' ELSE 'test' END"
_WSD = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_DENSE = "replace(lower(regexp_replace({0}, '" + _WSD.replace("{", "{{").replace("}", "}}") + "', '', 'g')), 'ß', 'ss')"
_AT = f"TIMESTAMPTZ '{AT}'"

SQL = {
    "tm_snapshot": _LATEST + f""", c AS (SELECT *, {_ID.format('meme_id')} AS key FROM l WHERE n = 1),
      a AS (SELECT key, x.asset_id AS asset_id, x.parent_asset_ids AS ps FROM (SELECT key, unnest(assets) AS x FROM c) WHERE {_ts('x.available_at')} <= {_AT} AND (x.published_at IS NULL OR {_ts('x.published_at')} <= {_AT}) AND x.asset_id IS NOT NULL),
      rel AS (SELECT DISTINCT key, asset_id, p FROM (SELECT key, asset_id, unnest(ps) AS p FROM a) WHERE p IN (SELECT asset_id FROM a))
      SELECT key, (SELECT count(DISTINCT asset_id) FROM a WHERE a.key = c.key) AS assets, (SELECT count(*) FROM rel WHERE rel.key = c.key) AS relations,
        (SELECT count(DISTINCT annotation_id) FROM annotations n WHERE {_ID.format('n.meme_id')} = c.key AND {_ts('n.available_at')} <= {_AT}) AS annotations,
        (SELECT count(DISTINCT example_id) FROM creation_examples e WHERE {_ID.format('e.meme_id')} = c.key AND {_ts('e.available_at')} <= {_AT}) AS examples FROM c""",
    "tm_snapshot_export": _LATEST + f""", e AS (SELECT example_id, {_SPLIT.format('split')} AS s, purpose, brief, target FROM creation_examples WHERE {_ts('available_at')} <= {_AT} AND {_ID.format('meme_id')} IN (SELECT {_ID.format('meme_id')} FROM l WHERE n = 1))
      SELECT DISTINCT example_id, route, sha256(coalesce(t, '')) AS text_sha FROM (
        SELECT example_id, 'excluded_no_split' AS route, '' AS t FROM e WHERE s IS NULL UNION ALL SELECT example_id, 'excluded_no_purpose', '' FROM e WHERE s IS NOT NULL AND purpose IS NULL
        UNION ALL SELECT example_id, 'context', concat_ws(chr(31), brief, target) FROM e WHERE s = 'train' AND purpose IS NOT NULL
        UNION ALL SELECT example_id, 'evaluation_input', brief FROM e WHERE s <> 'train' AND purpose IS NOT NULL UNION ALL SELECT example_id, 'evaluation_target', target FROM e WHERE s <> 'train' AND purpose IS NOT NULL)""",
    "tm_two_axis": f"""WITH k AS (SELECT DISTINCT {_ID.format('meme_id')} AS key FROM meme_records WHERE {_ts('available_at')} <= TIMESTAMPTZ '{SUPPORT_AT}' AND (published_at IS NULL OR {_ts('published_at')} <= TIMESTAMPTZ '{SUPPORT_AT}') AND meme_id IS NOT NULL),
      e AS (SELECT example_id, {_ID.format('meme_id')} AS key, {_SPLIT.format('split')} AS s, {_ts('available_at')} AS t, sha256({_DENSE.format('brief')}) AS b, sha256({_DENSE.format('target')}) AS g FROM creation_examples WHERE example_id IS NOT NULL),
      c AS (SELECT * FROM e WHERE s = 'train' AND t <= TIMESTAMPTZ '{SUPPORT_AT}' AND key IN (SELECT key FROM k))
      SELECT DISTINCT example_id, 'context' AS state FROM c UNION SELECT example_id, CASE WHEN t IS NULL OR t > TIMESTAMPTZ '{EVALUATE_AT}' THEN 'not_available' WHEN t <= TIMESTAMPTZ '{SUPPORT_AT}' THEN 'before_support'
        WHEN key IS NULL OR key NOT IN (SELECT key FROM k) THEN 'record_unknown' WHEN EXISTS (SELECT 1 FROM c WHERE c.key = e.key AND c.example_id = e.example_id) THEN 'same_example_identity'
        WHEN EXISTS (SELECT 1 FROM c WHERE c.b = e.b AND c.g = e.g) THEN 'same_content' ELSE 'evaluated' END FROM e WHERE s IN ('dev', 'test')""",
    "gr_cc_split": f"WITH RECURSIVE {_ALL_EDGES}, {_REACH} SELECT substr(s, 3) AS meme_id, substr(g, 3) AS group_id FROM grp",
    "gr_partition": f"""WITH RECURSIVE {_EDGES}, {_REACH}, r AS (SELECT DISTINCT '0:' || {_NAMED.format('meme_id')} AS node, {_SPLIT.format('split')} AS w, version FROM meme_records WHERE {_NAMED.format('meme_id')} IS NOT NULL),
      j AS (SELECT node, w, CASE WHEN version = '1' THEN w END AS p, coalesce(g, node) AS g FROM r LEFT JOIN grp ON s = node),
      d AS (SELECT g, min(w) AS lo, max(w) AS hi, min(p) AS plo, max(p) AS phi FROM j GROUP BY g),
      o AS (SELECT g, coalesce(lo <> hi, false) AS conflict, CASE WHEN plo IS NOT NULL AND plo = phi AND lo = hi THEN plo WHEN lo IS NULL THEN {_BY_HASH.format(_POINT.format('g', 'seed-1'))} WHEN lo = hi THEN lo END AS split FROM d)
      SELECT DISTINCT substr(node, 3) AS meme_id, substr(g, 3) AS group_id, split, conflict FROM j JOIN o USING (g)""",
    "sx_family_partition": f"""WITH RECURSIVE tie AS (SELECT DISTINCT '0:' || {_NAMED.format('family_id')} AS a, '1:' || {_NAMED.format('source_group_id')} AS b FROM creation_examples WHERE {_NAMED.format('family_id')} IS NOT NULL AND {_NAMED.format('source_group_id')} IS NOT NULL), {_REACH},
      f AS (SELECT DISTINCT '0:' || {_NAMED.format('family_id')} AS node FROM creation_examples WHERE {_NAMED.format('family_id')} IS NOT NULL), j AS (SELECT node, coalesce(g, node) AS g FROM f LEFT JOIN grp ON s = node)
      SELECT substr(node, 3) AS family_id, {_BY_HASH.format(_POINT.format('g', 'seed-2'))} AS split FROM j""",
    "gr_taint": f"""WITH RECURSIVE a AS (SELECT {_ID.format('x.asset_id')} AS i, trim(x.source_url) AS u, x.parent_asset_ids AS ps, {_SPLIT.format('split')} AS s FROM (SELECT split, unnest(assets) AS x FROM meme_records)),
      e AS (SELECT DISTINCT {_ID.format('p')} AS x, i AS y FROM (SELECT i, unnest(ps) AS p FROM a) WHERE p IS NOT NULL AND i IS NOT NULL UNION SELECT v.i, w.i FROM a v JOIN a w ON v.u = w.u WHERE v.i IS NOT NULL AND w.i IS NOT NULL),
      t AS (SELECT DISTINCT i AS node FROM a WHERE s IN ('dev', 'test') AND i IS NOT NULL UNION SELECT e.y FROM t JOIN e ON e.x = t.node) SELECT node AS asset_id FROM t""",
    "tm_permission": f"""WITH a AS (SELECT record_id, {_ID.format('x.asset_id')} AS i, x.license_or_use_basis AS l, x.status AS st, {_SPLIT.format('split')} AS s FROM (SELECT record_id, split, unnest(assets) AS x FROM meme_records)),
      o AS (SELECT i, max(record_id) AS r FROM a WHERE s = 'test' AND i IS NOT NULL GROUP BY i)
      SELECT DISTINCT i AS asset_id FROM a LEFT JOIN o USING (i) WHERE i IS NOT NULL AND coalesce(CASE WHEN r % 2 = 0 THEN false END, l IS NOT NULL) AND st = 'ok'""",
    "flt_validate_records": f"""WITH r AS (SELECT *, {_ts('available_at')} AS k, {_ts('published_at')} AS p FROM meme_records), a AS (SELECT record_id, k, unnest(assets) AS a FROM r), b AS (SELECT record_id, count(DISTINCT coalesce(a.asset_id, chr(0))) < count(*) AS rep,
        bool_or(coalesce(trim(a.asset_id), '') = '') AS no_id, bool_or(coalesce(trim(a.source_group_id), '') = '') AS no_group, bool_or(NOT coalesce(starts_with(a.source_url, 'https://'), false)) AS url, bool_or(NOT coalesce(a.modality IN ('text', 'image', 'audio', 'video'), false)) AS modality,
        bool_or(coalesce(trim(a.license_or_use_basis), '') = '') AS lic, bool_or(NOT coalesce(a.status = 'ok', false)) AS missing, bool_or({_ts('a.available_at')} IS NULL) AS bad, bool_or(a.published_at IS NOT NULL AND {_ts('a.published_at')} IS NULL) AS badp,
        bool_or({_ts('a.available_at')} > k) AS late, bool_or(coalesce(list_contains(a.parent_asset_ids, a.asset_id), false)) AS own FROM a GROUP BY record_id),
      x AS (SELECT unnest(list_filter([CASE WHEN coalesce(trim(meme_id), '') = '' THEN 'meme_id' END, CASE WHEN family_id IS NULL THEN 'family_id' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(platform), '') = '' THEN 'platform' END,
        CASE WHEN NOT coalesce(regexp_full_match(version, '[0-9]+'), false) THEN 'version' END, CASE WHEN NOT coalesce(provenance IN ('actual_collected', 'researcher_authored', 'ai_synthetic'), false) THEN 'provenance' END, CASE WHEN split NOT IN ('train', 'dev', 'test') THEN 'split' END,
        CASE WHEN k IS NULL THEN 'available_at' END, CASE WHEN published_at IS NOT NULL AND p IS NULL THEN 'published_at' END, CASE WHEN p > k THEN 'published_after_available' END, CASE WHEN coalesce(len(assets), 0) = 0 THEN 'no_asset' END], lambda v: v IS NOT NULL)) AS rule FROM r
        UNION ALL SELECT unnest(list_filter([CASE WHEN rep THEN 'repeated_asset' END, CASE WHEN no_id THEN 'asset_id' END, CASE WHEN no_group THEN 'asset_group' END, CASE WHEN url THEN 'asset_url' END, CASE WHEN modality THEN 'asset_modality' END, CASE WHEN lic THEN 'asset_license' END,
        CASE WHEN missing THEN 'asset_missing' END, CASE WHEN bad THEN 'asset_time' END, CASE WHEN badp THEN 'asset_published_time' END, CASE WHEN late THEN 'asset_before_record' END, CASE WHEN own THEN 'own_parent' END], lambda v: v IS NOT NULL)) FROM b)
      SELECT rule, count(*) AS rows FROM x GROUP BY rule""",
    "tm_merge_ingest": f"""WITH r AS (SELECT {_ID.format('meme_id')} AS key, version, {_ts('available_at')} AS t, assets FROM meme_records WHERE meme_id IS NOT NULL), a AS (SELECT key, unnest(assets) AS a FROM r)
      SELECT 'repeated_version' AS rule, key, count(*) AS n FROM (SELECT key, version FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY key
      UNION ALL SELECT 'versions_at_one_time', key, count(*) FROM (SELECT key, t FROM r WHERE t IS NOT NULL GROUP BY ALL HAVING count(DISTINCT version) > 1) GROUP BY key
      UNION ALL SELECT 'unknown_parent', key, count(DISTINCT p) FROM (SELECT key, unnest(a.parent_asset_ids) AS p FROM a) WHERE p IS NOT NULL AND p NOT IN (SELECT a.asset_id FROM a WHERE a.asset_id IS NOT NULL) GROUP BY key""",
    "flt_validate_dataset": f"""WITH e AS (SELECT family_id, source_group_id, {_SPLIT.format('split')} AS s, sha256({_DENSE.format('target')}) AS h FROM creation_examples WHERE {_SPLIT.format('split')} IS NOT NULL)
      SELECT 'family_id' AS kind, family_id AS value, count(DISTINCT s) AS splits FROM e WHERE family_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT s) > 1
      UNION ALL SELECT 'source_group_id', source_group_id, count(DISTINCT s) FROM e WHERE source_group_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT s) > 1
      UNION ALL SELECT 'text_sha', h, count(DISTINCT s) FROM e WHERE h IS NOT NULL GROUP BY 2 HAVING count(DISTINCT s) > 1
      UNION ALL SELECT 'no_support', family_id, count(DISTINCT s) FROM e WHERE family_id IS NOT NULL GROUP BY 2 HAVING count(*) FILTER (WHERE s = 'train') = 0""",
    "join_lineage_verify": f"""WITH a AS (SELECT {_NAMED.format('x.asset_id')} AS i, {_ts('x.available_at')} AS t, x.parent_asset_ids AS ps FROM (SELECT unnest(assets) AS x FROM meme_records)), f AS (SELECT i, min(t) AS t FROM a WHERE i IS NOT NULL GROUP BY i),
      l AS (SELECT DISTINCT i, {_NAMED.format('p')} AS p FROM (SELECT i, unnest(ps) AS p FROM a WHERE i IS NOT NULL) WHERE {_NAMED.format('p')} IS NOT NULL)
      SELECT l.i AS asset_id, l.p AS parent, CASE WHEN g.i IS NULL THEN 'parent_missing' WHEN g.t > f.t THEN 'parent_later' ELSE 'verified' END AS state FROM l JOIN f ON f.i = l.i LEFT JOIN f g ON g.i = l.p""",
    "join_manifest": """WITH a AS (SELECT provenance, x.source_url AS path, concat_ws('|', x.modality, x.status) AS d FROM (SELECT provenance, unnest(assets) AS x FROM meme_records)),
      i AS (SELECT path, min(d) AS lo, max(d) AS hi FROM a WHERE provenance = 'actual_collected' GROUP BY path), m AS (SELECT path, min(d) AS lo, max(d) AS hi FROM a WHERE provenance <> 'actual_collected' GROUP BY path)
      SELECT coalesce(i.path, m.path) AS path, CASE WHEN i.lo IS NULL THEN 'not_there' WHEN m.lo IS NULL THEN 'not_listed' WHEN m.lo <> m.hi THEN 'listed_twice' WHEN i.lo = m.lo AND i.hi = m.lo THEN 'verified' ELSE 'digest_differs' END AS state FROM i FULL JOIN m ON i.path = m.path""",
    "join_left_missing": f"""WITH r AS (SELECT {_ID.format('meme_id')} AS m, bool_or(coalesce({_ts('available_at')} <= {_AT}, false) AND (published_at IS NULL OR coalesce({_ts('published_at')} <= {_AT}, false))) AS ok FROM meme_records WHERE meme_id IS NOT NULL GROUP BY 1)
      SELECT annotation_id, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'there' ELSE 'excluded' END AS state FROM (SELECT DISTINCT annotation_id, {_ID.format('meme_id')} AS m FROM annotations) a LEFT JOIN r ON a.m = r.m""",
    "tm_backdate_guard": f"""SELECT DISTINCT annotation_id FROM annotations a JOIN (SELECT {_ID.format('meme_id')} AS m, min({_ts('available_at')}) AS f FROM meme_records GROUP BY 1) r ON {_ID.format('a.meme_id')} = r.m WHERE {_ts('a.available_at')} < f""",
    "flt_knowledge": f"""SELECT CASE WHEN author.type IS NULL OR author.type NOT IN ('ai', 'system', 'human') THEN 'knowledge_not_automatic' WHEN author.type = 'human' OR coalesce(human_minutes, 0) > 0 THEN 'human_or_reviewed' WHEN {_ts('available_at')} IS NULL THEN 'available_at_missing_or_invalid'
      WHEN {_ts('available_at')} > {_AT} THEN 'not_available_at_interpretation' WHEN coalesce(trim(content), '') = '' THEN 'knowledge_empty' ELSE 'admitted' END AS reason, count(*) AS n FROM annotations GROUP BY 1""",
    "flt_examples": f"""WITH r AS (SELECT family_id, example_id, target, CASE WHEN example_id IS NULL THEN 'invalid_example' WHEN {_ts('available_at')} IS NULL THEN 'available_at_missing_or_invalid' WHEN {_ts('available_at')} > {_AT} THEN 'not_available_at_interpretation' END AS r1 FROM creation_examples WHERE family_id IS NOT NULL),
      o AS (SELECT family_id, example_id, min(target) AS t, count(*) AS n, row_number() OVER (PARTITION BY family_id ORDER BY example_id) AS p FROM r WHERE r1 IS NULL GROUP BY family_id, example_id)
      SELECT family_id, example_id, CASE WHEN p > 2 THEN 'example_cap' END AS reason, CASE WHEN p <= 2 THEN substr(t, 1, 60) END AS excerpt, CASE WHEN p <= 2 AND length(t) > 60 THEN (length(t) - 60)::INT END AS cut_letters FROM o
      UNION ALL SELECT family_id, example_id, 'duplicate', NULL, NULL FROM o WHERE n > 1 UNION ALL SELECT family_id, example_id, r1, NULL, NULL FROM r WHERE r1 IS NOT NULL""",
    "flt_raw_obs": f"""WITH o AS (SELECT *, {_ts('posted_at')} AS p, {_ts('collected_at')} AS c, {_ts('available_at')} AS a, {_ts('updated_at')} AS u FROM observations)
      SELECT CASE WHEN text IS NULL OR observation_id IS NULL THEN 'text_or_id_missing' WHEN NOT coalesce(provenance IN ('actual_collected', 'researcher_authored', 'ai_synthetic'), false) THEN 'provenance'
        WHEN p IS NULL THEN 'posted_at_missing_or_invalid' WHEN p > TIMESTAMPTZ '2024-01-05T00:00:00Z' THEN 'posted_at_after_cutoff' WHEN c IS NULL THEN 'collected_at_missing_or_invalid' WHEN c > TIMESTAMPTZ '2024-01-05T00:00:00Z' THEN 'collected_at_after_cutoff'
        WHEN a IS NULL THEN 'available_at_missing_or_invalid' WHEN a > TIMESTAMPTZ '2024-01-05T00:00:00Z' THEN 'available_at_after_cutoff' WHEN updated_at <> '' AND (u IS NULL OR u > TIMESTAMPTZ '2024-01-05T00:00:00Z') THEN 'updated_at_missing_or_after_cutoff' ELSE 'admitted' END AS reason, count(*) AS n FROM o GROUP BY 1""",
    "flt_window": f"""SELECT CAST(CAST({_ts('posted_at')} AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) AS n FROM observations WHERE {_ts('posted_at')} >= TIMESTAMPTZ '2023-12-01T00:00:00Z' AND {_ts('posted_at')} < TIMESTAMPTZ '2024-01-01T00:00:00Z' GROUP BY 1""",
    "set_subset": """SELECT record_id, len(list_filter(flatten([x.parent_asset_ids for x in assets]), lambda p: NOT list_contains([x.asset_id for x in assets], p))) = 0 AS closed FROM meme_records""",
}


def queries():
    return {f.__name__: f for f in (
        tm_snapshot, tm_snapshot_export, tm_two_axis, gr_cc_split, gr_partition, sx_family_partition, gr_taint, tm_permission, flt_validate_records, tm_merge_ingest, flt_validate_dataset,
        join_lineage_verify, join_manifest, join_left_missing, tm_backdate_guard, flt_knowledge, flt_examples, flt_raw_obs, flt_window, set_subset,
    )}


def oracle_sql():
    return dict(SQL)
