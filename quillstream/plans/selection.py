"""Queries of joins, aggregations, windows, tops, samples and sets on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import experiments as X
from quillstream.operators import review as R
from quillstream.operators import selection as L
from quillstream.operators.admission import first_reason
from quillstream.plans.core_p import _ts, clean_id
from quillstream.plans.dataset import _ID, _SPLIT, split_of
from quillstream.plans.functions import _CORE, _lines
from quillstream.plans.studies import _digest
from quillstream.session import table


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_cards")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations")


def _tag_uses(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d).where("text is not null and observation_id is not null")
    return o.select("observation_id", "source_id", "video_id", "channel_id", F.unix_micros(instant("available_at")).alias("at"), F.explode(F.array_distinct(T.hashtags(F.col("text")))).alias("tag"))


def agg_df(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of tags: how many observations hold each, and a digest of which."""
    return L.support_of(_tag_uses(spark, d), "tag", "observation_id", "source_id", "video_id", "channel_id", "at").select("tag", "rows", "support")


def agg_distinct_src(spark: SparkSession, d: str) -> DataFrame:
    s = L.support_of(_tag_uses(spark, d), "tag", "observation_id", "source_id", "video_id", "channel_id", "at")
    return s.where("sources >= 2 and videos >= 2").select("tag", "sources", "videos", "channels")


def agg_minmax_time(spark: SparkSession, d: str) -> DataFrame:
    s = L.support_of(_tag_uses(spark, d), "tag", "observation_id", "source_id", "video_id", "channel_id", "at")
    return s.select("tag", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


def agg_hint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per query: distinct videos and channels found, and the latest publication among them."""
    c = _cards(spark, d).where("query is not null")
    return c.groupBy("query").agg(F.count_distinct("video_id").alias("videos"), F.count_distinct("channel_id").alias("channels"), F.max(F.unix_micros(instant("posted_at"))).cast("string").alias("latest"))


def agg_recent_uses(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each channel posted within 30 days of a time."""
    at = F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    t = instant("posted_at")
    return _observations(spark, d).where("channel_id is not null").groupBy("channel_id").agg(F.count_if((t >= at - F.expr("interval 30 days")) & (t <= at)).alias("recent"), F.count(F.lit(1)).alias("rows"))


def agg_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What can be said of each card's title, by how often."""
    c = _cards(spark, d)
    decision = first_reason((F.coalesce(F.trim("title"), F.lit("")) == "", "no_title"), (F.col("title").rlike(R.CUES), "possible_meme"), (F.col("description").rlike(R.NOTICE), "likely_notice"))
    return c.groupBy(F.coalesce(decision, F.lit("requires_evidence")).alias("decision")).agg(F.count(F.lit(1)).alias("cards"))


def agg_content_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per channel, the texts that several of its observations share: how many observations, and a digest of which."""
    o = _observations(spark, d).where("text is not null and channel_id is not null").select("channel_id", F.sha2(T.dense(F.col("text")), 256).alias("text_sha"), "observation_id", "input_line")
    return o.groupBy("channel_id", "text_sha").agg(F.count(F.lit(1)).alias("rows"), F.min("input_line").alias("first_line")).where("rows > 1")


def agg_bundle_counts(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d).where("channel_id is not null")
    return o.groupBy("channel_id").agg(F.count_distinct("source_id").alias("documents"), F.count_distinct("video_id").alias("videos"), F.count_distinct("text").alias("texts"))


def join_hash_eq(spark: SparkSession, d: str) -> DataFrame:
    """Tags' supporting observations joined back to their platforms."""
    o = _observations(spark, d).select(F.col("observation_id").alias("oid"), F.lower("platform").alias("platform")).where("oid is not null and platform is not null").distinct()
    u = _tag_uses(spark, d).select("tag", F.col("observation_id").alias("oid")).distinct()
    return u.join(o, "oid").groupBy("tag", "platform").agg(F.count(F.lit(1)).alias("n"))


def join_contains(spark: SparkSession, d: str) -> DataFrame:
    """Search queries and the cards whose title or description holds them as words: an equi-join on first words."""
    c = _cards(spark, d).select("card_id", T.normalized(F.concat_ws(" ", "title", "description")).alias("text"))
    q = _cards(spark, d).where("query is not null").select("query", T.normalized(F.col("query")).alias("phrase")).distinct()
    return T.containing(c, q, "text", "phrase").groupBy("query").agg(F.count_distinct("card_id").alias("cards"))


def join_token_contains(spark: SparkSession, d: str) -> DataFrame:
    """Titles that hold a search query, any card's, as whole words."""
    c = _cards(spark, d).where("title is not null").select("card_id", T.normalized(F.col("title")).alias("text"))
    q = _cards(spark, d).where("query is not null").select(T.normalized(F.col("query")).alias("phrase")).distinct()
    return T.containing(c, q, "text", "phrase").select("card_id", "phrase").distinct()


def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of memes that have a training record."""
    r = table(spark, d, "meme_records").where(split_of(F.col("split")) == "train").select(clean_id(F.col("meme_id")).alias("m"))
    a = table(spark, d, "annotations").withColumn("m", clean_id(F.col("meme_id")))
    return a.join(r, "m", "left_semi").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a completed response of one condition."""
    r = table(spark, d, "generation_responses").where("case_id is not null")
    return r.select("case_id").distinct().join(r.where("condition = 'CR' and status = 'completed'").select("case_id"), "case_id", "left_anti")


def join_sql(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines, in Spark's own SQL over views."""
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(f"v_{name}")
    return spark.sql("SELECT o.o_orderstatus AS status, count(*) AS lines, count(DISTINCT o.o_orderkey) AS orders FROM v_lineitem l JOIN v_orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1")


def join_frame_key(spark: SparkSession, d: str) -> DataFrame:
    """Titles of a shared three-word frame, by frame: how many pairs of different titles it ties, without making them."""
    f = R.shared_frames(_cards(spark, d), 3, 2)
    return f.select("frame", "titles", (F.col("titles") * (F.col("titles") - 1) / 2).cast("long").alias("pairs"))


def op_shared_frames(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_frames(_cards(spark, d), 3, 3)


def op_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """For each dev and test example, the three nearest train examples of its family, by rounded score and id."""
    e = table(spark, d, "creation_examples").select("example_id", F.col("family_id").alias("grp"), F.col("brief").alias("text"), split_of(F.col("split")).alias("s"))
    queries_ = e.where("s in ('dev', 'test')").select(F.col("example_id").alias("query_id"), "grp", "text")
    out = X.tfidf_retrieve(queries_, e.where("s = 'train'").select("example_id", "grp", "text"), 3)
    return out.withColumn("score", F.round("score", 6))


def win_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The latest collected observation of each platform, source and modality; ties go to the greater id, then the later line."""
    o = _observations(spark, d).where("source_id is not null and observation_id is not null").withColumn("t", instant("collected_at")).where("t is not null")
    return o.groupBy(F.lower("platform").alias("platform"), "source_id", "modality").agg(F.max(F.struct("t", "observation_id", "input_line")).alias("x")).select("platform", "source_id", "modality", "x.input_line")


def win_dup_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Observation ids given several times, by whether their texts agree."""
    o = _observations(spark, d).where("observation_id is not null").groupBy("observation_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("text", F.lit("\u0000"))).alias("a"), F.max(F.coalesce("text", F.lit("\u0000"))).alias("b")).where("n > 1")
    return o.select("observation_id", "n", F.when(F.col("a") == F.col("b"), "duplicate_observation").otherwise("conflicting_observation_id").alias("state"))


def win_rank(spark: SparkSession, d: str) -> DataFrame:
    """All videos by their sightings, then id, with their rank."""
    v = _cards(spark, d).where("video_id is not null").groupBy("video_id").agg(F.count(F.lit(1)).alias("sightings"))
    return L.ranked(v, [F.desc("sightings"), F.asc("video_id")])


def win_reference_append(spark: SparkSession, d: str) -> DataFrame:
    return L.referenced(_cards(spark, d), "video_id", "card_id")


def topk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The 200 title phrases of most videos, longer ones first among equals."""
    uses = _cards(spark, d).where("title is not null").select("video_id", F.explode(T.phrases(T.normalized(F.col("title")), 4)).alias("phrase"))
    counts = uses.groupBy("phrase").agg(F.count_distinct("video_id").alias("videos"))
    return counts.orderBy(F.desc("videos"), F.desc(F.length("phrase")), "phrase").limit(200)


def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 50 tags of most sources, then videos, with an id made of the tag."""
    s = L.support_of(_tag_uses(spark, d), "tag", "observation_id", "source_id", "video_id", "channel_id", "at")
    return s.select(T.hash_id("c_", F.col("tag")).alias("candidate_id"), "tag", "sources", "videos").orderBy(F.desc("sources"), F.desc("videos"), "candidate_id").limit(50)


def topk_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The first five observations of each channel by time, then line, as its bundle."""
    o = _observations(spark, d).where("channel_id is not null").select("channel_id", "input_line", instant("available_at").alias("t")).where("t is not null")
    return L.top_per_group(o, ["channel_id"], [F.col("t"), F.col("input_line")], 5, F.col("input_line")).select("channel_id", "input_line", "place")


def first_n_matching(spark: SparkSession, d: str) -> DataFrame:
    """The first three cards of each query, in search order, whose title holds it."""
    c = _cards(spark, d).where("search_rank is not null").where(F.lower("title").contains(F.lower("query")))
    best = c.groupBy("query", "video_id").agg(F.min(F.struct("search_rank", "card_id")).alias("x")).select("query", "video_id", "x.*")
    return L.top_per_group(best, ["query"], [F.col("search_rank"), F.col("card_id")], 3, F.col("video_id")).select("query", "video_id", "card_id", "place")


def sort_families(spark: SparkSession, d: str) -> DataFrame:
    """Families by whether several source groups hold them, then source groups, then examples."""
    f = table(spark, d, "creation_examples").where("family_id is not null").groupBy("family_id").agg(F.count_distinct("source_group_id").alias("groups"), F.count(F.lit(1)).alias("examples"))
    return L.ranked(f.withColumn("supported", F.col("groups") >= 2), [F.desc("supported"), F.desc("groups"), F.desc("examples"), F.asc("family_id")], "place")


def sort_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each query's videos by rank, best first, then video."""
    c = _cards(spark, d).where("query is not null and search_rank is not null and video_id is not null").groupBy("query", "video_id").agg(F.min("search_rank").alias("rank"))
    return L.top_per_group(c, ["query"], [F.col("rank"), F.col("video_id")], 10, F.col("video_id"))


def limit_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The examples of each family that fit 600 letters, in order."""
    e = table(spark, d, "creation_examples").where("family_id is not null and brief is not null")
    return L.within_budget(e, "family_id", "example_id", F.length("brief"), 600)


def sample_even(spark: SparkSession, d: str) -> DataFrame:
    """Seven evenly spaced character positions of each document."""
    docs = table(spark, d, "documents").where("n_chars > 0")
    return docs.select("doc_id", F.array_join(L.even_positions(F.col("n_chars"), 7), ",").alias("spots"))


def set_union_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two tables in one, by kind."""
    a = table(spark, d, "annotations").select(F.col("content").alias("text"), F.lit("annotation").alias("kind"), "role")
    e = table(spark, d, "creation_examples").select(F.col("target").alias("text"), F.lit("example").alias("kind"), "purpose")
    u = a.unionByName(e, allowMissingColumns=True)
    return u.groupBy("kind", "role", "purpose").agg(F.count("text").alias("texts"))


def set_union_ids(spark: SparkSession, d: str) -> DataFrame:
    """All asset ids of each meme over its versions, once each."""
    r = table(spark, d, "meme_records").where("meme_id is not null").select("meme_id", F.explode("assets").alias("a")).select("meme_id", "a.asset_id").where("asset_id is not null").distinct()
    return r.groupBy("meme_id").agg(F.count(F.lit(1)).alias("assets"), L.set_digest(F.col("asset_id")).alias("ids"))


def set_eq(spark: SparkSession, d: str) -> DataFrame:
    """Cases by whether both models answered the same conditions."""
    r = table(spark, d, "generation_responses")
    return L.same_sets(r.where("model_id = 'local-model-a'"), r.where("model_id = 'local-model-b'"), "case_id", "condition")


def set_dedupe_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Words of titles, each at its first place only."""
    return _cards(spark, d).where("title is not null").select("card_id", F.array_join(F.array_distinct(T.tokens(F.col("title"))), " ").alias("words"))


def sx_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per query: cards, the deepest rank, and whether its results were exhausted, bounded by the deepest rank of all, or failed."""
    c = _cards(spark, d).where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("cards"), F.max("search_rank").alias("deepest"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) != "").alias("titled"))
    bound = _cards(spark, d).agg(F.max("search_rank").alias("bound"))
    state = F.when(F.col("titled") == 0, "failed").when(F.col("deepest") >= F.col("bound"), "bounded").otherwise("exhausted")
    return c.crossJoin(F.broadcast(bound)).select("query", "cards", "deepest", state.alias("state"))  # one row


def sx_select_refs(spark: SparkSession, d: str) -> DataFrame:
    """The first five distinct videos of each query, each with all its sightings."""
    c = _cards(spark, d).where("query is not null and video_id is not null")
    best = c.groupBy("query", "video_id").agg(F.min("search_rank").alias("rank"), F.min("card_id").alias("card"), F.count(F.lit(1)).alias("sightings"))
    return L.top_per_group(best, ["query"], [F.col("rank").asc_nulls_last(), F.col("card")], 5, F.col("video_id")).select("query", "video_id", "sightings", "place")


def sx_observe(spark: SparkSession, d: str) -> DataFrame:
    """Why observations would not be taken in: unusable or future times, updates before publication, outside of the window, no
    text, seen before."""
    o = _observations(spark, d)
    posted, updated, collected = instant("posted_at"), instant("updated_at"), instant("collected_at")
    start, end = (F.lit(t).cast("timestamp") for t in ("2023-06-01T00:00:00Z", "2024-06-01T00:00:00Z"))
    r = o.select("input_line", F.sha2(F.concat_ws("\u001f", "source_id", "text"), 256).alias("content"), first_reason(
        (posted.isNull() | collected.isNull(), "missing_or_invalid_timestamp"), (posted > collected, "future_dated"), (updated < posted, "updated_before_posted"),
        ((posted < start) | (posted >= end), "outside_window"), (F.coalesce(F.trim("text"), F.lit("")) == "", "missing_text"),
    ).alias("r1"))
    first = r.where("r1 is null").groupBy("content").agg(F.min("input_line").alias("first"))
    j = r.join(first, "content", "left")
    return j.select("input_line", F.coalesce("r1", F.when(F.col("input_line") != F.col("first"), "duplicate_content"), F.lit("observed")).alias("reason"))


def sx_watch_collect(spark: SparkSession, d: str) -> DataFrame:
    """Videos of search cards with the observations that speak of them."""
    c = _cards(spark, d).where("video_id is not null").groupBy("video_id").agg(F.count(F.lit(1)).alias("cards"))
    o = _observations(spark, d).where("video_id is not null and observation_id is not null").select("video_id", "observation_id").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("observations"), L.set_digest(F.col("observation_id")).alias("ids"))
    return c.join(o, "video_id", "left").select("video_id", "cards", F.coalesce("observations", F.lit(0)).alias("observations"), "ids")


def sx_workflow_search(spark: SparkSession, d: str) -> DataFrame:
    """Queries in order while their cards fit a budget, with where they came from."""
    q = _cards(spark, d).where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("cards")).withColumn("origin", F.lit("search"))
    return L.within_budget(q, "origin", "query", F.col("cards"), 1000).select("query", "origin", "used")


def sx_assoc(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and the ids tied to them, from maps and from lists alike."""
    c = _cards(spark, d).where("query is not null and video_id is not null")
    maps = c.select(F.explode(F.map_from_arrays(F.array("query"), F.array(F.array("video_id", F.col("card_id").cast("string"))))).alias("seed", "ids")).select("seed", F.explode("ids").alias("id"))
    lists = c.select(F.col("query").alias("seed"), F.explode(F.array("video_id", "channel_id")).alias("id"))
    return maps.unionByName(lists).where("id is not null").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("ids"))


def sx_example(spark: SparkSession, d: str) -> DataFrame:
    """Each family's examples by whether its annotations were known before them (initial) or only later (post hoc)."""
    e = table(spark, d, "creation_examples").select("example_id", clean_id(F.col("meme_id")).alias("m"), instant("available_at").alias("t")).where("m is not null and t is not null")
    a = table(spark, d, "annotations").select(clean_id(F.col("meme_id")).alias("m"), instant("available_at").alias("at")).where("m is not null and at is not null")
    first = a.groupBy("m").agg(F.min("at").alias("first"))
    return e.join(first, "m", "left").select("example_id", F.when(F.col("first").isNull(), "none").when(F.col("first") <= F.col("t"), "initial").otherwise("post_hoc").alias("known")).distinct()


def sx_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Lines of descriptions that hold the card's query, with the cues on the same line."""
    c = _cards(spark, d).where("description is not null and query is not null").select("card_id", "query", F.posexplode(T.lines(F.col("description"))).alias("n", "line"))
    return c.where(F.lower("line").contains(F.lower("query"))).select("card_id", (F.col("n") + 1).alias("line_number"), F.size(F.regexp_extract_all("line", F.lit(R.CUES), F.lit(0))).alias("cues"))


def _tags() -> str:
    from quillstream.plans.functions import _CONTACT, _W

    return f"""u AS (SELECT DISTINCT observation_id, source_id, video_id, channel_id, epoch_us({_ts('available_at')}) AS t, unnest(regexp_extract_all(regexp_replace(text, '{_CONTACT}', chr(10), 'g'), '(?:^|[^{_W}#])#([가-힣A-Za-z0-9_]+)', 1)) AS tag FROM observations WHERE text IS NOT NULL AND observation_id IS NOT NULL),
      x AS (SELECT tag, observation_id, min(source_id) AS s, min(video_id) AS v, min(channel_id) AS c, min(t) AS t FROM u GROUP BY tag, observation_id)"""


_TAGS = _tags()
_TOK = "regexp_extract_all(lower({0}), '[가-힣A-Za-z0-9]+')"
_GRAMS = """g AS (SELECT DISTINCT video_id, phrase FROM (
      SELECT video_id, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + n - 1], ' ') AS phrase FROM (SELECT video_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= n)) WHERE regexp_matches(phrase, '[가-힣]')
      UNION SELECT video_id, y FROM (SELECT video_id, unnest(w) AS y FROM w) WHERE regexp_full_match(y, '[가-힣]{3,}'))"""

SQL = {
    "agg_df": f"WITH {_TAGS} SELECT tag, count(*) AS rows, {_digest('observation_id')} AS support FROM x GROUP BY tag",
    "agg_distinct_src": f"WITH {_TAGS} SELECT tag, count(DISTINCT s) AS sources, count(DISTINCT v) AS videos, count(DISTINCT c) AS channels FROM x GROUP BY tag HAVING count(DISTINCT s) >= 2 AND count(DISTINCT v) >= 2",
    "agg_minmax_time": f"WITH {_TAGS} SELECT tag, CAST(min(t) AS VARCHAR) AS first, CAST(max(t) AS VARCHAR) AS last FROM x GROUP BY tag",
    "agg_hint_counts": f"SELECT query, count(DISTINCT video_id) AS videos, count(DISTINCT channel_id) AS channels, CAST(max(epoch_us({_ts('posted_at')})) AS VARCHAR) AS latest FROM video_cards WHERE query IS NOT NULL GROUP BY query",
    "agg_recent_uses": f"SELECT channel_id, count(*) FILTER (WHERE {_ts('posted_at')} BETWEEN TIMESTAMPTZ '2024-01-05T00:00:00Z' - INTERVAL 30 DAYS AND TIMESTAMPTZ '2024-01-05T00:00:00Z') AS recent, count(*) AS rows FROM observations WHERE channel_id IS NOT NULL GROUP BY channel_id",
    "agg_decisions": f"""SELECT CASE WHEN coalesce(trim(title, ' '), '') = '' THEN 'no_title' WHEN regexp_matches(title, '{R.CUES}') THEN 'possible_meme' WHEN regexp_matches(description, '{R.NOTICE}') THEN 'likely_notice' ELSE 'requires_evidence' END AS decision, count(*) AS cards FROM video_cards GROUP BY 1""",
    "agg_content_groups": """SELECT channel_id, sha256(@DENSE@) AS text_sha, count(*) AS rows, min(input_line) AS first_line FROM observations WHERE text IS NOT NULL AND channel_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
    "agg_bundle_counts": "SELECT channel_id, count(DISTINCT source_id) AS documents, count(DISTINCT video_id) AS videos, count(DISTINCT text) AS texts FROM observations WHERE channel_id IS NOT NULL GROUP BY channel_id",
    "join_hash_eq": f"WITH {_TAGS}, o AS (SELECT DISTINCT observation_id, lower(platform) AS platform FROM observations WHERE observation_id IS NOT NULL AND platform IS NOT NULL) SELECT tag, platform, count(*) AS n FROM x JOIN o USING (observation_id) GROUP BY tag, platform",
    "join_contains": f"""WITH c AS (SELECT card_id, ' ' || array_to_string({_TOK.format("concat_ws(' ', title, description)")}, ' ') || ' ' AS t FROM video_cards), q AS (SELECT DISTINCT query, ' ' || array_to_string({_TOK.format('query')}, ' ') || ' ' AS p FROM video_cards WHERE query IS NOT NULL)
      SELECT query, count(DISTINCT card_id) AS cards FROM c JOIN q ON contains(t, p) WHERE trim(p) <> '' GROUP BY query""",
    "join_token_contains": f"""WITH c AS (SELECT card_id, ' ' || array_to_string({_TOK.format('title')}, ' ') || ' ' AS t FROM video_cards WHERE title IS NOT NULL), q AS (SELECT DISTINCT array_to_string({_TOK.format('query')}, ' ') AS phrase FROM video_cards WHERE query IS NOT NULL)
      SELECT DISTINCT card_id, phrase FROM c JOIN q ON phrase <> '' AND contains(t, ' ' || phrase || ' ')""",
    "join_semi": f"SELECT role, count(*) AS n FROM annotations WHERE {_ID.format('meme_id')} IN (SELECT {_ID.format('meme_id')} FROM meme_records WHERE {_SPLIT.format('split')} = 'train' AND meme_id IS NOT NULL) GROUP BY role",
    "join_anti": "SELECT DISTINCT case_id FROM generation_responses WHERE case_id IS NOT NULL AND case_id NOT IN (SELECT case_id FROM generation_responses WHERE case_id IS NOT NULL AND condition = 'CR' AND status = 'completed')",
    "join_sql": "SELECT o_orderstatus AS status, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "join_frame_key": f"""WITH t AS (SELECT video_id, {_TOK.format(_CORE)} AS w FROM video_cards WHERE title IS NOT NULL), u AS (SELECT video_id, array_to_string(w, ' ') AS t, unnest(list_distinct([array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 2], ' ') for i in range(1, len(w) - 1)])) AS frame FROM t WHERE len(w) >= 3),
      f AS (SELECT frame, count(DISTINCT t) AS titles, count(DISTINCT video_id) AS videos FROM u GROUP BY frame) SELECT frame, titles, CAST(titles * (titles - 1) / 2 AS BIGINT) AS pairs FROM f WHERE titles >= 2 AND videos >= 2""",
    "op_shared_frames": f"""WITH t AS (SELECT video_id, channel_id, {_TOK.format(_CORE)} AS w FROM video_cards WHERE title IS NOT NULL), u AS (SELECT video_id, channel_id, array_to_string(w, ' ') AS t, unnest(list_distinct([array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 2], ' ') for i in range(1, len(w) - 1)])) AS frame FROM t WHERE len(w) >= 3)
      SELECT frame, count(DISTINCT t) AS titles, count(DISTINCT video_id) AS videos, count(DISTINCT channel_id) AS channels FROM u GROUP BY frame HAVING count(DISTINCT t) >= 3 AND count(DISTINCT video_id) >= 3""",
    "op_retrieve": f"""WITH e AS (SELECT example_id, family_id AS grp, lower(regexp_replace(brief, '[@SPACE@]+', '', 'g')) AS s, {_SPLIT.format('split')} AS k FROM creation_examples WHERE family_id IS NOT NULL AND brief IS NOT NULL),
      b AS (SELECT example_id, grp, k, term, count(*) AS c FROM (SELECT example_id, grp, k, substr(s, CAST(i AS BIGINT), n) AS term FROM (SELECT *, unnest(range(1, length(s) - n + 2)) AS i FROM e, (VALUES (2), (3)) v(n) WHERE length(s) >= n)) GROUP BY ALL),
      nn AS (SELECT grp, count(DISTINCT example_id) AS n FROM e WHERE k = 'train' GROUP BY grp), df AS (SELECT grp, term, count(*) AS df FROM b WHERE k = 'train' GROUP BY grp, term),
      w AS (SELECT b.example_id, b.grp, b.k, b.term, (1 + ln(c)) * (ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS w FROM b JOIN nn USING (grp) LEFT JOIN df ON df.grp = b.grp AND df.term = b.term),
      m AS (SELECT example_id, sqrt(sum(w * w)) AS m FROM w GROUP BY example_id),
      p AS (SELECT q.example_id AS query_id, d.example_id, sum(q.w * d.w) AS dot FROM w q JOIN w d ON q.grp = d.grp AND q.term = d.term WHERE q.k IN ('dev', 'test') AND d.k = 'train' GROUP BY 1, 2),
      s AS (SELECT query_id, p.example_id, dot / (x.m * y.m) AS score FROM p JOIN m x ON x.example_id = query_id JOIN m y ON y.example_id = p.example_id)
      SELECT query_id, example_id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, example_id))::INT AS rank FROM s) WHERE rank <= 3""",
    "win_latest_snapshot": f"""SELECT lower(platform) AS platform, source_id, modality, arg_max(input_line, ({_ts('collected_at')}, observation_id, input_line)) AS input_line FROM observations WHERE source_id IS NOT NULL AND observation_id IS NOT NULL AND {_ts('collected_at')} IS NOT NULL GROUP BY 1, 2, 3""",
    "win_dup_conflict": "SELECT observation_id, count(*) AS n, CASE WHEN count(DISTINCT coalesce(text, chr(0))) = 1 THEN 'duplicate_observation' ELSE 'conflicting_observation_id' END AS state FROM observations WHERE observation_id IS NOT NULL GROUP BY observation_id HAVING count(*) > 1",
    "win_rank": "SELECT video_id, count(*) AS sightings, row_number() OVER (ORDER BY count(*) DESC, video_id) AS rank FROM video_cards WHERE video_id IS NOT NULL GROUP BY video_id",
    "win_reference_append": "SELECT video_id, min(card_id) OVER (PARTITION BY video_id) AS first, card_id, card_id <> min(card_id) OVER (PARTITION BY video_id) AS repeated FROM video_cards WHERE video_id IS NOT NULL",
    "topk_nodes": f"WITH w AS (SELECT video_id, {_TOK.format('title')} AS w FROM video_cards WHERE title IS NOT NULL), {_GRAMS} SELECT phrase, count(DISTINCT video_id) AS videos FROM g GROUP BY phrase ORDER BY videos DESC, length(phrase) DESC, phrase LIMIT 200",
    "topk_candidates": f"WITH {_TAGS} SELECT 'c_' || substr(sha256(tag), 1, 20) AS candidate_id, tag, count(DISTINCT s) AS sources, count(DISTINCT v) AS videos FROM x GROUP BY tag ORDER BY sources DESC, videos DESC, candidate_id LIMIT 50",
    "topk_bundle": f"""SELECT channel_id, input_line, place FROM (SELECT channel_id, input_line, (row_number() OVER (PARTITION BY channel_id ORDER BY {_ts('available_at')}, input_line))::INT AS place FROM observations WHERE channel_id IS NOT NULL AND {_ts('available_at')} IS NOT NULL) WHERE place <= 5""",
    "first_n_matching": """WITH b AS (SELECT query, video_id, min(search_rank) AS r, arg_min(card_id, (search_rank, card_id)) AS card_id FROM video_cards WHERE search_rank IS NOT NULL AND contains(lower(title), lower(query)) GROUP BY query, video_id)
      SELECT query, video_id, card_id, place FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY r, card_id))::INT AS place FROM b) WHERE place <= 3""",
    "sort_families": """WITH f AS (SELECT family_id, count(DISTINCT source_group_id) AS groups, count(*) AS examples FROM creation_examples WHERE family_id IS NOT NULL GROUP BY family_id)
      SELECT *, groups >= 2 AS supported, row_number() OVER (ORDER BY groups >= 2 DESC, groups DESC, examples DESC, family_id) AS place FROM f""",
    "sort_matches": """WITH c AS (SELECT query, video_id, min(search_rank) AS rank FROM video_cards WHERE query IS NOT NULL AND search_rank IS NOT NULL AND video_id IS NOT NULL GROUP BY query, video_id)
      SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY rank, video_id))::INT AS place FROM c) WHERE place <= 10""",
    "limit_tokens": """SELECT family_id, example_id, used FROM (SELECT family_id, example_id, CAST(sum(greatest(length(brief), 1)) OVER (PARTITION BY family_id ORDER BY example_id) AS BIGINT) AS used FROM creation_examples WHERE family_id IS NOT NULL AND brief IS NOT NULL) WHERE used <= 600""",
    "sample_even": """WITH d AS (SELECT doc_id, [CAST(round_even(i * (n_chars - 1) / 6.0, 0) AS BIGINT) for i in range(0, 7)] AS s FROM documents WHERE n_chars > 0) SELECT doc_id, array_to_string(list_sort(list_distinct(s)), ',') AS spots FROM d""",
    "set_union_rows": """SELECT kind, role, purpose, count(text) AS texts FROM (SELECT content AS text, 'annotation' AS kind, role, NULL AS purpose FROM annotations UNION ALL SELECT target, 'example', NULL, purpose FROM creation_examples) GROUP BY ALL""",
    "set_union_ids": f"""WITH r AS (SELECT DISTINCT meme_id, x.asset_id AS i FROM (SELECT meme_id, unnest(assets) AS x FROM meme_records WHERE meme_id IS NOT NULL) WHERE x.asset_id IS NOT NULL) SELECT meme_id, count(*) AS assets, {_digest('i')} AS ids FROM r GROUP BY meme_id""",
    "set_eq": """WITH x AS (SELECT case_id, list_sort(list(DISTINCT condition)) AS c FROM generation_responses WHERE model_id = 'local-model-a' AND case_id IS NOT NULL GROUP BY case_id), y AS (SELECT case_id, list_sort(list(DISTINCT condition)) AS c FROM generation_responses WHERE model_id = 'local-model-b' AND case_id IS NOT NULL GROUP BY case_id)
      SELECT coalesce(x.case_id, y.case_id) AS case_id, CASE WHEN y.case_id IS NULL THEN 'left_only' WHEN x.case_id IS NULL THEN 'right_only' WHEN x.c = y.c THEN 'equal' ELSE 'differs' END AS state FROM x FULL JOIN y ON x.case_id = y.case_id""",
    "set_dedupe_ordered": f"""WITH t AS (SELECT card_id, {_TOK.format('title')} AS w FROM video_cards WHERE title IS NOT NULL) SELECT card_id, array_to_string(list_filter(w, lambda y, i: list_position(w, y) = i), ' ') AS words FROM t""",
    "sx_coverage": """WITH c AS (SELECT query, count(*) AS cards, max(search_rank) AS deepest, count(*) FILTER (WHERE coalesce(trim(title, ' '), '') <> '') AS titled FROM video_cards WHERE query IS NOT NULL GROUP BY query)
      SELECT query, cards, deepest, CASE WHEN titled = 0 THEN 'failed' WHEN deepest >= (SELECT max(search_rank) FROM video_cards) THEN 'bounded' ELSE 'exhausted' END AS state FROM c""",
    "sx_select_refs": """WITH b AS (SELECT query, video_id, min(search_rank) AS r, min(card_id) AS c, count(*) AS sightings FROM video_cards WHERE query IS NOT NULL AND video_id IS NOT NULL GROUP BY query, video_id)
      SELECT query, video_id, sightings, place FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY r NULLS LAST, c))::INT AS place FROM b) WHERE place <= 5""",
    "sx_observe": f"""WITH r AS (SELECT input_line, sha256(concat_ws(chr(31), source_id, text)) AS h, {_ts('posted_at')} AS p, {_ts('updated_at')} AS u, {_ts('collected_at')} AS c, text FROM observations),
      s AS (SELECT input_line, h, CASE WHEN p IS NULL OR c IS NULL THEN 'missing_or_invalid_timestamp' WHEN p > c THEN 'future_dated' WHEN u < p THEN 'updated_before_posted' WHEN p < TIMESTAMPTZ '2023-06-01T00:00:00Z' OR p >= TIMESTAMPTZ '2024-06-01T00:00:00Z' THEN 'outside_window' WHEN coalesce(trim(text, ' '), '') = '' THEN 'missing_text' END AS r1 FROM r)
      SELECT input_line, coalesce(r1, CASE WHEN row_number() OVER (PARTITION BY h, r1 IS NULL ORDER BY input_line) > 1 THEN 'duplicate_content' END, 'observed') AS reason FROM s""",
    "sx_watch_collect": f"""WITH c AS (SELECT video_id, count(*) AS cards FROM video_cards WHERE video_id IS NOT NULL GROUP BY video_id), o AS (SELECT video_id, count(*) AS observations, {_digest('observation_id')} AS ids FROM (SELECT DISTINCT video_id, observation_id FROM observations WHERE video_id IS NOT NULL AND observation_id IS NOT NULL) GROUP BY video_id)
      SELECT video_id, cards, coalesce(observations, 0) AS observations, ids FROM c LEFT JOIN o USING (video_id)""",
    "sx_workflow_search": "SELECT query, 'search' AS origin, used FROM (SELECT query, CAST(sum(count(*)) OVER (ORDER BY query) AS BIGINT) AS used FROM video_cards WHERE query IS NOT NULL GROUP BY query) WHERE used <= 1000",
    "sx_assoc": "SELECT seed, count(DISTINCT id) AS ids FROM (SELECT query AS seed, unnest([video_id, CAST(card_id AS VARCHAR), channel_id]) AS id FROM video_cards WHERE query IS NOT NULL AND video_id IS NOT NULL) WHERE id IS NOT NULL GROUP BY seed",
    "sx_example": f"""WITH e AS (SELECT example_id, {_ID.format('meme_id')} AS m, {_ts('available_at')} AS t FROM creation_examples WHERE meme_id IS NOT NULL AND {_ts('available_at')} IS NOT NULL), a AS (SELECT {_ID.format('meme_id')} AS m, min({_ts('available_at')}) AS f FROM annotations WHERE meme_id IS NOT NULL AND {_ts('available_at')} IS NOT NULL GROUP BY 1)
      SELECT DISTINCT example_id, CASE WHEN f IS NULL THEN 'none' WHEN f <= t THEN 'initial' ELSE 'post_hoc' END AS known FROM e LEFT JOIN a USING (m)""",
    "sx_excerpt": f"""WITH l AS (SELECT card_id, query, {_lines('description')} AS l FROM video_cards WHERE description IS NOT NULL AND query IS NOT NULL), x AS (SELECT card_id, query, i AS line_number, l[i] AS t FROM (SELECT card_id, query, l, unnest(range(1, len(l) + 1)) AS i FROM l))
      SELECT card_id, line_number, len(regexp_extract_all(t, '{R.CUES}'))::INT AS cues FROM x WHERE contains(lower(t), lower(query))""",
}


def queries():
    return {f.__name__: f for f in (
        agg_df, agg_distinct_src, agg_minmax_time, agg_hint_counts, agg_recent_uses, agg_decisions, agg_content_groups, agg_bundle_counts, join_hash_eq, join_contains, join_token_contains, join_semi, join_anti,
        join_sql, join_frame_key, op_shared_frames, op_retrieve, win_latest_snapshot, win_dup_conflict, win_rank, win_reference_append, topk_nodes, topk_candidates, topk_bundle, first_n_matching,
        sort_families, sort_matches, limit_tokens, sample_even, set_union_rows, set_union_ids, set_eq, set_dedupe_ordered, sx_coverage, sx_select_refs, sx_observe, sx_watch_collect, sx_workflow_search,
        sx_assoc, sx_example, sx_excerpt,
    )}


def oracle_sql():
    from quillstream.plans.functions import _SPACE
    from quillstream.plans.governance import _DENSE

    return {k: v.replace("@DENSE@", _DENSE.format("text")).replace("@SPACE@", _SPACE) for k, v in SQL.items()}
