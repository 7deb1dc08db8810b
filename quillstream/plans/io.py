"""Queries that send test tables through the sinks and sources and read them back, with the SQL of what must come out."""

from __future__ import annotations

import json
import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.session import fresh_path, table
from quillstream.sources import readers as R
from quillstream.sources import sinks as K


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("props").alias("props"))


def src_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines, read back by schema."""
    path = fresh_path(spark, "jsonl")
    K.write_once(_events(spark, d), path)
    return _summary(R.json_lines(spark, path, "event_id long, user_id long, event_type string, value double, props string")[0])


def src_jsonl2(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no objects, told apart from those that are, and keys outside of the schema."""
    path = fresh_path(spark, "jsonl")
    line = F.when(F.col("event_id") % 7 == 0, "[1]").when(F.col("event_id") % 11 == 0, "broken").otherwise(F.to_json(F.struct("event_id", "event_type")))
    _events(spark, d).select(line.alias("value")).write.text(path)
    rows, rejects = R.json_lines(spark, path, "event_id long")
    return rejects.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.agg(F.lit("rows").alias("raw"), F.count(F.lit(1)).alias("n")))


def src_json_strict(spark: SparkSession, d: str) -> DataFrame:
    """The split fractions by way of a strict JSON document."""
    rows = {r["split"]: r["fraction"] for r in table(spark, d, "split_fractions").collect()}  # a fixed table of three rows
    path = Path(tempfile.mkdtemp()) / "splits.json"
    path.write_text(json.dumps(rows))
    return spark.createDataFrame(sorted(R.strict_json(str(path)).items()), "split string, fraction double")


def src_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    _events(spark, d).select("event_id", "user_id", "event_type").write.option("header", True).csv(path)
    return R.csv(spark, path, "event_id long, user_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


def src_sqlite(spark: SparkSession, d: str) -> DataFrame:
    """The context windows by way of a SQLite file."""
    rows = [tuple(r) for r in table(spark, d, "context_windows").select("model_id", "capacity").collect()]  # a fixed table of two rows
    path = str(Path(tempfile.mkdtemp()) / "windows.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table windows (model_id text, capacity int)")
        db.executemany("insert into windows values (?, ?)", rows)
    return R.sqlite_table(spark, path, "windows", "model_id string, capacity int")


def src_api_project(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as JSON, the allowed field only."""
    raw = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("user"), F.col("value").alias("hidden")).alias("inner")))
    p = _events(spark, d).select(R.projected(raw, "id long, inner struct<user:long>").alias("p"))
    return p.groupBy("p.inner.user").agg(F.count(F.lit(1)).alias("n"))


def _video():
    """The video id as one of the usual shape."""
    return F.substring(F.concat(F.regexp_replace("video_id", "[^A-Za-z0-9_-]", "x"), F.lit("x" * 11)), 1, 11)


def src_search_html(spark: SparkSession, d: str) -> DataFrame:
    """Cards set in search pages, one card a page beside an advertisement, read back."""
    c = table(spark, d, "video_cards").where("title is not null and title <> '' and video_id is not null").select("card_id", _video().alias("v"), "title")
    card = F.struct(F.struct(F.col("v").alias("videoId"), F.struct(F.col("title").alias("simpleText")).alias("title")).alias("videoRenderer"))
    tree = F.to_json(F.struct(F.struct(F.struct(F.array(card).alias("items")).alias("primaryContents"), F.struct(F.struct(F.lit("zzzzzzzzzzz").alias("videoId")).alias("videoRenderer")).alias("adSlotRenderer")).alias("contents")))
    pages = c.select("card_id", F.concat(F.lit("<script>var ytInitialData = "), tree, F.lit(";</script>")).alias("html"))
    return R.search_cards(pages, "card_id").where("reason is null").select(F.col("page_id").alias("card_id"), "search_rank", "video_id", F.sha2("title", 256).alias("title_sha"))


def src_watch_html(spark: SparkSession, d: str) -> DataFrame:
    """Cards set in watch pages: by the player's data, of another video, by linked data, or behind a consent page."""
    c = table(spark, d, "video_cards").where("title is not null and video_id is not null").select("card_id", _video().alias("v"), "title", (F.col("card_id") % 4).alias("k"))
    player = F.to_json(F.struct(F.struct(F.when(F.col("k") == 1, "yyyyyyyyyyy").otherwise(F.col("v")).alias("videoId"), F.col("title").alias("title")).alias("videoDetails")))
    linked = F.to_json(F.struct(F.lit("VideoObject").alias("@type"), F.concat(F.lit("https://www.youtube.com/watch?v="), "v").alias("url"), F.col("title").alias("name")))
    html = F.when(F.col("k") <= 1, F.concat(F.lit("<script>var ytInitialPlayerResponse = "), player, F.lit(";</script>"))).when(F.col("k") == 2, F.concat(F.lit('<script type="application/ld+json">'), linked, F.lit("</script>"))).otherwise(F.lit("<title>Before you continue to"))
    got = R.watch_metadata(c.select("card_id", F.col("v").alias("video_id"), html.alias("html")).select("video_id", "html"))
    return got.groupBy("video_id", F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.count("title").alias("titles"), F.count(F.lit(1)).alias("pages"))


def src_challenge(spark: SparkSession, d: str) -> DataFrame:
    pages = _events(spark, d).select(F.when(F.col("event_type") == "view", F.lit("<title>Before you continue")).when(F.col("event_type") == "click", F.lit("<title>Sorry")).when(F.col("event_type") == "error", F.lit("<title>Sign in - x")).otherwise(F.lit("<title>x")).alias("html"))
    return pages.groupBy(F.coalesce(R.page_challenge(F.col("html")), F.lit("none")).alias("challenge")).agg(F.count(F.lit(1)).alias("n"))


def src_atom(spark: SparkSession, d: str) -> DataFrame:
    """Cards set in feeds of one entry, read back with their reasons."""
    c = table(spark, d, "video_cards").where("channel_id is not null and video_id is not null").select("card_id", _video().alias("v"), "channel_id", "posted_at")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    when = F.coalesce(F.col("posted_at"), F.lit("none"))
    entry = tag("entry", F.concat(tag("yt:videoId", F.col("v")), tag("yt:channelId", F.when(F.col("card_id") % 5 == 0, "UCother").otherwise(F.col("channel_id"))), tag("title", F.lit("t")), tag("published", when), tag("updated", when)))
    feeds = c.select("channel_id", F.lit("2024-02-01T00:00:00Z").alias("received_at"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="y">'), entry, F.lit("</feed>")).alias("body"))
    out = R.atom(feeds, max_entries=1 << 20)
    return out.where("reason = 'entry_channel_mismatch'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def src_rss(spark: SparkSession, d: str) -> DataFrame:
    """Queries set in a trend feed each, read back."""
    q = table(spark, d, "video_cards").where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    item = F.concat(F.lit("<item><title>"), "query", F.lit("</title><link>l</link><pubDate>Mon, 01 Jan 2024 09:00:00 +0900</pubDate><ht:approx_traffic>"), F.col("n").cast("string"), F.lit("+</ht:approx_traffic></item>"))
    feeds = q.select(F.lit("2024-06-01T00:00:00Z").alias("received_at"), F.concat(F.lit('<rss xmlns:ht="h"><channel><title>c</title>'), item, F.lit("</channel></rss>")).alias("body"))
    return R.rss(feeds).select("topic", F.col("approx_traffic_raw").alias("traffic"), F.unix_micros("posted_at").cast("string").alias("posted_us"), F.coalesce("reason", F.lit("")).alias("reason"))


def src_wiki_p(spark: SparkSession, d: str) -> DataFrame:
    """Annotations set as paragraphs with a note and a tag inside, read back."""
    a = table(spark, d, "annotations").where("content is not null").select("annotation_id", F.concat(F.lit("<p class=x><b>"), T.html_escape(F.col("content")), F.lit("</b><sup>[1]</sup></p><p> </p>")).alias("html")).distinct()
    return a.select("annotation_id", F.explode(R.paragraphs(F.col("html"))).alias("text"))


def src_binary(spark: SparkSession, d: str) -> DataFrame:
    """The files of the small tables, by length and digest, as often as read."""
    one = R.files(spark, d, "split_fractions*.parquet").unionByName(R.files(spark, d, "context_windows*.parquet"))
    return one.select((F.col("length") > 0).alias("filled"), (F.length("sha256") == 64).alias("digest")).distinct()


def src_archive(spark: SparkSession, d: str) -> DataFrame:
    """Documents as archived bytes against receipts, some of which are wrong or missing."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    receipts = docs.where("doc_id % 5 <> 0").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("gone-"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 11 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return R.verified_archive(docs.select("path", "sha256"), receipts).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def snk_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A write-once table; the second write must fail and leave the first."""
    path = fresh_path(spark, "once")
    K.write_once(_events(spark, d), path)
    try:
        K.write_once(_events(spark, d).limit(1), path)
        again = True
    except Exception as e:  # the error that the path stands already
        if "exist" not in str(e):
            raise
        again = False
    return _summary(spark.read.schema("event_id long, event_type string, props string").json(path)).withColumn("written_again", F.lit(again))


def snk_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    K.write_once(_events(spark, d).select("event_id", "event_type"), path, "csv")
    return spark.read.schema("event_id long, event_type string").csv(path).groupBy("event_type").agg(F.sum("event_id").alias("ids"))


def snk_multi(spark: SparkSession, d: str) -> DataFrame:
    """Events in several outputs of one run, each read back."""
    path, e = fresh_path(spark, "several"), _events(spark, d)
    K.write_several({"errors": e.where("event_type = 'error'"), "others": e.where("event_type <> 'error'")}, path)
    one = lambda name: spark.read.schema("event_id long").json(f"{path}/{name}").agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return one("errors").unionByName(one("others"))


def snk_append(spark: SparkSession, d: str) -> DataFrame:
    """Events appended type by type to one table."""
    path, e = fresh_path(spark, "appended"), _events(spark, d)
    K.append(e.where("event_id % 2 = 0"), path)
    K.append(e.where("event_id % 2 = 1"), path)
    return _summary(spark.read.parquet(path))


def snk_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a written table: all rows are there, and a rewritten table has the same digest."""
    one, two, e = fresh_path(spark, "m"), fresh_path(spark, "m"), _events(spark, d).select("event_id", "event_type")
    e.coalesce(1).write.parquet(one)
    e.orderBy(F.desc("event_id")).coalesce(1).write.parquet(two)
    a, b = K.manifest(spark.read.parquet(one)), K.manifest(spark.read.parquet(two))
    return a.join(b.select("content_sha256", F.col("rows").alias("again")), "content_sha256", "left").select("rows", (F.col("rows") == F.col("again")).alias("same"))


def snk_cas(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored by content in the shared folder: how many copies of how many."""
    docs = table(spark, d, "documents").where("text is not null and doc_id < 1000000000").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")).where("path is not null")
    stored = K.content_store(docs, fresh_path(spark, "cas"))
    return stored.groupBy("sha256").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("copy").alias("copies"))


def snk_export_events(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "export")
    K.export_events(_events(spark, d), "event_id", path)
    return _summary(spark.read.schema("event_id long, event_type string, props string").json(path))


def snk_md(spark: SparkSession, d: str) -> DataFrame:
    """A report table of the events' types, read back line by line."""
    text = K.markdown_table(_summary(_events(spark, d)).orderBy("event_type"), ["event_type", "n"], 100)
    lines = spark.createDataFrame([(line,) for line in text.splitlines()[2:]], "line string")
    return lines.select(F.trim(F.get(F.split("line", r"\|"), F.lit(1))).alias("event_type"), F.trim(F.get(F.split("line", r"\|"), F.lit(2))).cast("long").alias("n"))


_SUM = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT props) AS props FROM events GROUP BY event_type"
_V = "substr(regexp_replace(video_id, '[^A-Za-z0-9_-]', 'x', 'g') || 'xxxxxxxxxxx', 1, 11)"

SQL = {
    "src_jsonl": _SUM, "snk_append": _SUM, "snk_export_events": _SUM,
    "snk_jsonl": _SUM.replace(" FROM", ", false AS written_again FROM"),
    "src_jsonl2": "SELECT CASE WHEN event_id % 7 = 0 THEN '[1]' WHEN event_id % 11 = 0 THEN 'broken' ELSE 'rows' END AS raw, count(*) AS n FROM events GROUP BY 1",
    "src_json_strict": "SELECT split, fraction FROM split_fractions",
    "src_csv": "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type",
    "src_sqlite": "SELECT model_id, capacity FROM context_windows",
    "src_api_project": 'SELECT user_id AS "user", count(*) AS n FROM events GROUP BY 1',
    "src_search_html": f"SELECT card_id, 1 AS search_rank, {_V} AS video_id, sha256(title) AS title_sha FROM video_cards WHERE title IS NOT NULL AND title <> '' AND video_id IS NOT NULL",
    "src_watch_html": f"""SELECT {_V} AS video_id, CASE card_id % 4 WHEN 1 THEN 'video_identity_mismatch' WHEN 3 THEN 'consent_required' ELSE 'read' END AS reason, count(*) FILTER (WHERE card_id % 4 IN (0, 2)) AS titles, count(*) AS pages FROM video_cards WHERE title IS NOT NULL AND video_id IS NOT NULL GROUP BY 1, 2""",
    "src_challenge": "SELECT CASE event_type WHEN 'view' THEN 'consent_required' WHEN 'click' THEN 'captcha_or_traffic_block' WHEN 'error' THEN 'login_required' ELSE 'none' END AS challenge, count(*) AS n FROM events GROUP BY 1",
    "src_atom": "SELECT 'entry_channel_mismatch' AS reason, count(*) AS n FROM video_cards WHERE channel_id IS NOT NULL AND video_id IS NOT NULL AND card_id % 5 = 0",
    "src_rss": "SELECT query AS topic, count(*) || '+' AS traffic, CAST(epoch_us(TIMESTAMPTZ '2024-01-01T00:00:00Z') AS VARCHAR) AS posted_us, '' AS reason FROM video_cards WHERE query IS NOT NULL GROUP BY query",
    "src_wiki_p": r"SELECT DISTINCT annotation_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS text FROM annotations WHERE content IS NOT NULL AND trim(content) <> ''",
    "src_binary": "SELECT true AS filled, true AS digest",
    "src_archive": """WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'gone-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS path FROM d WHERE doc_id % 5 <> 0)
      SELECT CASE WHEN d.doc_id IS NULL THEN 'missing_file' WHEN r.path IS NULL THEN 'no_receipt' WHEN r.doc_id % 11 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS state, count(*) AS n FROM d FULL JOIN r ON CAST(d.doc_id AS VARCHAR) = r.path GROUP BY 1""",
    "snk_csv": "SELECT event_type, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
    "snk_multi": "SELECT CASE WHEN event_type = 'error' THEN 'errors' ELSE 'others' END AS output, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "snk_manifest": "SELECT count(*) AS rows, true AS same FROM events",
    "snk_cas": "SELECT sha256(text) AS sha256, count(*) AS paths, 1 AS copies FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1",
    "snk_md": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}


def queries():
    return {f.__name__: f for f in (
        src_jsonl, src_jsonl2, src_json_strict, src_csv, src_sqlite, src_api_project, src_search_html, src_watch_html, src_challenge, src_atom, src_rss, src_wiki_p, src_binary, src_archive,
        snk_jsonl, snk_csv, snk_multi, snk_append, snk_manifest, snk_cas, snk_export_events, snk_md,
    )}


def oracle_sql():
    return dict(SQL)
