"""Discovery queries: admission, lines, tags, boilerplate, phrases, candidates, seeds, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import discovery as D
from quillstream.operators import seeds as S
from quillstream.operators.admission import admit
from quillstream.plans.core_p import _ts
from quillstream.session import keep, table

#: Cutoff of the admission queries.
CUTOFF = "2024-01-05T00:00:00Z"


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations")


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    """Admitted rows of collected data; kept once, as several branches read them."""
    return keep(admit(_observations(spark, d), CUTOFF).where("reason is null and provenance = 'actual_collected'"))


def flt_admit(spark: SparkSession, d: str) -> DataFrame:
    return admit(_observations(spark, d), CUTOFF).select("input_line", F.coalesce("reason", F.lit("eligible")).alias("reason"))


def agg_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    return flt_admit(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def flt_ts_guard(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    return o.select("input_line", F.unix_micros(instant("posted_at")).cast("string").alias("posted_us"), F.unix_micros(instant("updated_at")).cast("string").alias("updated_us"))


def fn_date_info(spark: SparkSession, d: str) -> DataFrame:
    info = T.date_info(F.col("posted_at"))
    return _observations(spark, d).select(info["precision"].alias("precision")).groupBy("precision").agg(F.count(F.lit(1)).alias("n"))


def fn_char_grams(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "creation_examples").where("target is not null").select(F.explode(T.char_ngrams(F.col("target"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def fn_bigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "creation_examples").where("brief is not null and target is not null")
    return e.select("example_id", F.round(T.bigram_jaccard(F.col("brief"), F.col("target")), 6).alias("jaccard"))


def fn_hash_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.hash_id("doc_", F.col("source"), F.col("text")).alias("content_id"))


def agg_repeat_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    lines = docs.select("source", "video_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.lower(F.trim("line"))).where("line <> ''")
    return lines.groupBy("source", "line").agg(F.count_distinct("video_id").alias("videos")).where("videos >= 2")


def agg_phrase_support(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two and three words within lines, with the documents and sources they occur in, two at least of each."""
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select("doc_id", "source", T.tokens(F.col("line")).alias("w"))
    uses = words.select("doc_id", "source", F.explode(T.word_ngrams(F.col("w"), 2, 3)).alias("phrase"))
    counts = uses.groupBy("phrase").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"))
    return counts.where("docs >= 2 and sources >= 2")


def op_metadata_index(spark: SparkSession, d: str) -> DataFrame:
    """Suppressed lines by reason, and lines kept."""
    lines = D.line_reasons(D.text_lines(_eligible(spark, d)))
    return lines.groupBy("field", F.coalesce("suppressed", F.lit("kept")).alias("suppressed")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("video_id").alias("videos"))


def op_detect_d0(spark: SparkSession, d: str) -> DataFrame:
    return _named_times(D.detect(_eligible(spark, d), method="D0"))


def _named_times(candidates: DataFrame) -> DataFrame:
    """Candidates with their times as microseconds and the measures that single phrases have."""
    us = lambda c: F.unix_micros(c).cast("string")
    return candidates.select(
        "candidate_id", "representative_phrase", "source_document_frequency", "source_video_count", "distinct_observed_content_count", "observation_count", "channel_count", "title_support", "hashtag_support",
        "description_support", us("first_observed_available_at").alias("first_us"), us("last_observed_available_at").alias("last_us"),
    )


def agg_score(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all sources, and of titles among them, of the candidates."""
    c = D.detect(_eligible(spark, d), method="D0")
    return c.select(F.col("representative_phrase").alias("phrase"), F.round("source_fraction", 9).alias("source_fraction"), F.round(F.col("title_support") / F.col("source_document_frequency"), 9).alias("title_fraction"), "channel_count")


def op_detect_d1(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(_eligible(spark, d), method="D1", baseline_end="2023-12-01T00:00:00Z").drop("surface_forms")


def win_unique_video(spark: SparkSession, d: str) -> DataFrame:
    return S.unique_videos(table(spark, d, "video_cards"), "card_id").select("video_id", "card_id", "snapshots")


def win_first_seen(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "video_cards").where("video_id is not null")
    first = cards.groupBy("video_id").agg(F.min("card_id").alias("first"))
    return cards.join(first, "video_id").select("card_id", F.when(F.col("card_id") == F.col("first"), "first").otherwise("duplicate_video_card").alias("state"))


def op_plan_seeds(spark: SparkSession, d: str) -> DataFrame:
    videos = keep(S.unique_videos(table(spark, d, "video_cards"), "card_id"))
    return S.plan_seeds(videos, 50)


def op_followups(spark: SparkSession, d: str) -> DataFrame:
    videos = keep(S.unique_videos(table(spark, d, "video_cards"), "card_id"))
    return S.followups(keep(S.plan_seeds(videos, 50)), videos)


def op_families(spark: SparkSession, d: str) -> DataFrame:
    videos = keep(S.unique_videos(table(spark, d, "video_cards"), "card_id"))
    return S.families(keep(S.plan_seeds(videos, 50)), videos)


def op_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What supports no family, by reason."""
    videos = keep(S.unique_videos(table(spark, d, "video_cards"), "card_id"))
    return S.rejected(keep(S.plan_seeds(videos, 50)), videos).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def agg_day_hist(spark: SparkSession, d: str) -> DataFrame:
    days = _observations(spark, d).select(F.to_date(instant("posted_at")).alias("day")).where("day is not null")
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(F.col("day").cast("string").alias("day"), "n")


def agg_channel_frac(spark: SparkSession, d: str) -> DataFrame:
    """Share of a source's documents that carry a tag."""
    docs = table(spark, d, "documents").where("source is not null")
    tag = F.coalesce(F.col("text").rlike(r"#[가-힣A-Za-z0-9_]+"), F.lit(False))
    return docs.groupBy("source").agg(F.count_if(tag).alias("tagged"), F.count(F.lit(1)).alias("docs")).withColumn("fraction", F.round(F.col("tagged") / F.col("docs"), 9))


def agg_growth(spark: SparkSession, d: str) -> DataFrame:
    """Distinct videos of each modality before and after a day, as shares of all of their time."""
    base = F.lit("2023-12-01T00:00:00Z").cast("timestamp")
    o = _observations(spark, d).select("modality", "video_id", instant("posted_at").alias("t")).where("t is not null and video_id is not null")
    all_ = o.agg(F.count_distinct(F.when(F.col("t") <= base, F.col("video_id"))).alias("b"), F.count_distinct(F.when(F.col("t") > base, F.col("video_id"))).alias("r"))
    by = o.groupBy("modality").agg(F.count_distinct(F.when(F.col("t") <= base, F.col("video_id"))).alias("baseline"), F.count_distinct(F.when(F.col("t") > base, F.col("video_id"))).alias("recent"))
    return by.crossJoin(F.broadcast(all_)).select(  # one row
        "modality", "baseline", "recent", F.round(F.try_divide("recent", "r") - F.try_divide("baseline", "b"), 9).alias("difference")
    )


def topk_search_rank(spark: SparkSession, d: str) -> DataFrame:
    """The three best-placed cards of each search query."""
    cards = table(spark, d, "video_cards").where("query is not null and search_rank is not null")
    from pyspark.sql import Window

    local = F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("card_id"), F.lit(32))).orderBy("search_rank", "card_id"))
    first = cards.select("query", "card_id", "search_rank").withColumn("n", local).where("n <= 3")  # a hot query meets in one task only by its best
    place = F.row_number().over(Window.partitionBy("query").orderBy("search_rank", "card_id"))
    return first.withColumn("place", place).where("place <= 3").select("query", "card_id", "search_rank", "place")


_TOKENLESS = "NOT regexp_matches(text, '[가-힣A-Za-z0-9Ａ-Ｚａ-ｚ０-９ᄀ-ᇿ㉠-㉿①-⑳⁰¹²³⁴-⁹½¼¾™№℃ªº]')"
_REASONS = f"""
WITH o AS (SELECT *, {_ts('posted_at')} AS p, {_ts('collected_at')} AS c, {_ts('available_at')} AS a, {_ts('updated_at')} AS u,
  md5(concat_ws(chr(31), {', '.join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in ('batch_id', 'observation_id', 'platform', 'source_id', 'video_id', 'channel_id', 'modality', 'kind', 'text', 'context', 'posted_at', 'updated_at', 'collected_at', 'available_at', 'provenance', 'source_url', 'sample_method'))})) AS content
  FROM observations),
r AS (SELECT *, CASE
  WHEN observation_id IS NULL OR trim(observation_id) = '' THEN 'missing_or_invalid_observation_id'
  WHEN platform IS NULL OR trim(platform) = '' THEN 'missing_or_invalid_platform'
  WHEN source_id IS NULL OR trim(source_id) = '' THEN 'missing_or_invalid_source_id'
  WHEN video_id IS NULL OR trim(video_id) = '' THEN 'missing_or_invalid_video_id'
  WHEN modality IS NULL OR trim(modality) = '' THEN 'missing_or_invalid_modality'
  WHEN text IS NULL OR trim(text) = '' THEN 'missing_or_invalid_text'
  WHEN lower(platform) <> 'youtube' THEN 'unsupported_platform'
  WHEN provenance IS NULL OR provenance NOT IN ('actual_collected', 'researcher_authored', 'ai_synthetic') THEN 'missing_or_invalid_provenance'
  WHEN p IS NULL THEN 'missing_or_invalid_posted_at' WHEN p > TIMESTAMPTZ '{CUTOFF}' THEN 'posted_at_after_cutoff'
  WHEN c IS NULL THEN 'missing_or_invalid_collected_at' WHEN c > TIMESTAMPTZ '{CUTOFF}' THEN 'collected_at_after_cutoff'
  WHEN a IS NULL THEN 'missing_or_invalid_available_at' WHEN a > TIMESTAMPTZ '{CUTOFF}' THEN 'available_at_after_cutoff'
  WHEN updated_at <> '' AND u IS NULL THEN 'invalid_updated_at' WHEN u > TIMESTAMPTZ '{CUTOFF}' THEN 'updated_at_after_cutoff'
  WHEN p > c THEN 'posted_after_collection' WHEN u > c THEN 'updated_after_collection' WHEN a < p THEN 'available_before_posted'
  WHEN {_TOKENLESS} THEN 'empty_tokenized_text' END AS r1 FROM o),
f AS (SELECT *, first_value(content) OVER w AS fc, row_number() OVER w AS n FROM r WHERE r1 IS NULL WINDOW w AS (PARTITION BY observation_id ORDER BY input_line)),
g AS (SELECT *, CASE WHEN n > 1 AND content = fc THEN 'duplicate_observation'
  WHEN bool_or(content <> fc) OVER (PARTITION BY observation_id) THEN 'conflicting_observation_id' END AS r2 FROM f),
h AS (SELECT input_line, CASE WHEN row_number() OVER (PARTITION BY lower(platform), source_id, modality ORDER BY c DESC, observation_id DESC) > 1 THEN 'superseded_source_snapshot' ELSE 'eligible' END AS reason FROM g WHERE r2 IS NULL),
x AS (SELECT input_line, r1 AS reason FROM r WHERE r1 IS NOT NULL UNION ALL SELECT input_line, r2 FROM g WHERE r2 IS NOT NULL UNION ALL SELECT input_line, reason FROM h)
"""

_NOTICES = [p.replace("(?iU)", "(?i)").replace("'", "''") for p in (T.PRODUCTION_NOTICE, T.UPLOAD_NOTICE)]


#: Full-width letters and digits, and what they are composed to.
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _NARROW)


def _detect_sql() -> str:
    """Discovery of single phrases (D0) as common table expressions, up to the scored phrases `sc`."""
    from quillstream.plans.functions import _BREAK, _CONTACT, _W, _lines

    tag = f"(^|[^{_W}#])#([가-힣A-Za-z0-9_]+)"
    lower = "lower(line)"
    return _REASONS + f""", ob AS (SELECT o.observation_id, lower(o.platform) || chr(31) || o.source_id AS source, o.video_id, o.channel_id, array_to_string(regexp_extract_all(lower(translate(nfc_normalize(o.text), '{_WIDE}', '{_NARROW}')), '[가-힣A-Za-z0-9]+'), ' ') AS content, o.a AS available, o.p AS posted,
        CASE WHEN (lower(o.modality) = 'video_metadata' OR o.kind = 'video') AND o.context.video_title IS NOT NULL THEN [{{'f': 'title', 'v': o.context.video_title}}, {{'f': 'description', 'v': o.context.video_description}}]
          WHEN lower(o.modality) IN ('title', 'description') THEN [{{'f': lower(o.modality), 'v': o.text}}] WHEN contains(lower(o.modality), 'comment') OR o.kind IN ('comment', 'reply') THEN [{{'f': 'comment', 'v': o.text}}] ELSE [{{'f': 'text', 'v': o.text}}] END AS fs
        FROM o JOIN x USING (input_line) WHERE x.reason = 'eligible' AND o.provenance = 'actual_collected'),
      fl AS (SELECT observation_id, video_id, channel_id, f.f AS field, {_lines('f.v')} AS l FROM (SELECT observation_id, video_id, channel_id, unnest(fs) AS f FROM ob) WHERE f.v IS NOT NULL),
      ln AS (SELECT observation_id, video_id, channel_id, field, n, nfc_normalize(l[n]) AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM fl)),
      sg AS (SELECT *, list_filter([array_to_string(regexp_extract_all(lower(z), '[가-힣A-Za-z0-9]+'), ' ') for z in regexp_split_to_array(regexp_replace(regexp_replace(line, '{_CONTACT}', chr(10), 'g'), '{tag}', '\\1' || chr(10), 'g'), '{_BREAK}')], lambda q: q <> '') AS segs FROM ln),
      rp AS (SELECT channel_id, segs FROM sg WHERE field = 'description' AND channel_id <> '' AND len(segs) > 0 GROUP BY channel_id, segs HAVING count(DISTINCT video_id) >= 3),
      mk AS (SELECT sg.*, CASE WHEN field = 'description' AND regexp_matches(line, '{_NOTICES[0]}') THEN 'production_or_contact_notice' WHEN field = 'description' AND regexp_matches(line, '{_NOTICES[1]}') THEN 'upload_or_navigation_notice'
        WHEN field = 'description' AND rp.channel_id IS NOT NULL THEN 'same_channel_repeated_description_line' END AS sup FROM sg LEFT JOIN rp ON rp.channel_id = sg.channel_id AND rp.segs = sg.segs),
      wd AS (SELECT observation_id, field, sup, string_split(seg, ' ') AS w FROM (SELECT observation_id, field, sup, unnest(segs) AS seg FROM mk)),
      gr AS (SELECT observation_id, field, sup, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM wd, (VALUES (2), (3), (4), (5), (6)) v(n) WHERE len(w) >= n)),
      us AS (SELECT DISTINCT * FROM (SELECT phrase, observation_id, field AS origin, false AS prot, sup FROM gr WHERE regexp_matches(phrase, '[가-힣]')
        UNION ALL SELECT y, observation_id, field, false, sup FROM (SELECT observation_id, field, sup, unnest(w) AS y FROM wd) WHERE regexp_full_match(y, '[가-힣]{{3,}}')
        UNION ALL SELECT array_to_string(regexp_extract_all(lower(t), '[가-힣A-Za-z0-9]+'), ' '), observation_id, 'hashtag', true, NULL FROM (SELECT observation_id, unnest(regexp_extract_all(regexp_replace(line, '{_CONTACT}', chr(10), 'g'), '(?:^|[^{_W}#])#([가-힣A-Za-z0-9_]+)', 1)) AS t FROM mk) WHERE regexp_matches(lower(t), '[가-힣]'))),
      lv AS (SELECT * FROM us WHERE sup IS NULL),
      ix AS (SELECT phrase, bool_or(prot) AS prot, sha256(string_agg(DISTINCT observation_id, ',' ORDER BY observation_id)) AS sig FROM lv GROUP BY phrase),
      inn AS (SELECT DISTINCT sig, array_to_string(w[CAST(i AS BIGINT):CAST(j AS BIGINT)], ' ') AS phrase FROM (SELECT sig, w, i, unnest(range(i, len(w) + 1)) AS j FROM (SELECT sig, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT sig, string_split(phrase, ' ') AS w FROM ix WHERE contains(phrase, ' ')))) WHERE j - i + 1 < len(w)),
      kp AS (SELECT phrase FROM ix WHERE prot UNION ALL SELECT ix.phrase FROM ix LEFT JOIN inn ON inn.sig = ix.sig AND inn.phrase = ix.phrase WHERE NOT prot AND inn.phrase IS NULL),
      ev AS (SELECT lv.phrase, lv.origin, ob.* FROM lv JOIN kp USING (phrase) JOIN ob USING (observation_id)),
      nd AS (SELECT phrase FROM ev GROUP BY phrase HAVING count(DISTINCT source) >= 2 ORDER BY count(DISTINCT source) DESC, length(phrase) DESC, phrase LIMIT 3000),
      sc AS (SELECT phrase, count(DISTINCT source) AS source_document_frequency, count(DISTINCT video_id) AS source_video_count, count(DISTINCT content) AS distinct_observed_content_count, count(DISTINCT observation_id) AS observation_count, count(DISTINCT channel_id) AS channel_count,
        count(DISTINCT source) FILTER (WHERE origin = 'title') AS title_support, count(DISTINCT source) FILTER (WHERE origin = 'hashtag') AS hashtag_support, count(DISTINCT source) FILTER (WHERE origin = 'description') AS description_support, CAST(epoch_us(min(available)) AS VARCHAR) AS first_us, CAST(epoch_us(max(available)) AS VARCHAR) AS last_us
        FROM ev JOIN nd USING (phrase) GROUP BY phrase HAVING count(DISTINCT source) >= 2 AND count(DISTINCT video_id) >= 2)
"""


SQL = {
    "op_detect_d0": lambda: _detect_sql() + "SELECT 'qsc_' || substr(sha256(phrase), 1, 20) AS candidate_id, phrase AS representative_phrase, * EXCLUDE (phrase) FROM sc ORDER BY source_document_frequency DESC, source_video_count DESC, candidate_id LIMIT 100",
    "op_metadata_index": lambda: _detect_sql() + "SELECT field, coalesce(sup, 'kept') AS suppressed, count(*) AS lines, count(DISTINCT video_id) AS videos FROM mk GROUP BY 1, 2",
    "agg_score": lambda: _detect_sql() + "SELECT phrase, round(source_document_frequency / (SELECT count(DISTINCT source) FROM ob)::DOUBLE, 9) AS source_fraction, round(title_support / source_document_frequency::DOUBLE, 9) AS title_fraction, channel_count FROM sc ORDER BY source_document_frequency DESC, source_video_count DESC, 'qsc_' || substr(sha256(phrase), 1, 20) LIMIT 100",
    "flt_admit": _REASONS + "SELECT input_line, reason FROM x",
    "agg_reason_hist": _REASONS + "SELECT reason, count(*) AS n FROM x GROUP BY reason",
    "flt_ts_guard": f"SELECT input_line, CAST(epoch_us({_ts('posted_at')}) AS VARCHAR) AS posted_us, CAST(epoch_us({_ts('updated_at')}) AS VARCHAR) AS updated_us FROM observations",
    "fn_date_info": f"""SELECT CASE WHEN posted_at IS NULL OR trim(posted_at) = '' THEN 'missing' WHEN regexp_full_match(posted_at, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date'
      WHEN {_ts('posted_at')} IS NOT NULL THEN 'instant' ELSE 'invalid' END AS precision, count(*) AS n FROM observations GROUP BY 1""",
    "fn_char_grams": """WITH t AS (SELECT lower(regexp_replace(target, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g')) AS s FROM creation_examples WHERE target IS NOT NULL),
      g AS (SELECT substr(s, CAST(i AS BIGINT), 3) AS gram FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM t WHERE length(s) >= 3))
      SELECT gram, count(*) AS n FROM g GROUP BY gram""",
    "fn_bigram_jaccard": """WITH e AS (SELECT example_id, list_distinct([substr(brief, CAST(i AS BIGINT), 2) for i in range(1, length(brief))]) AS a, list_distinct([substr(target, CAST(i AS BIGINT), 2) for i in range(1, length(target))]) AS b
        FROM creation_examples WHERE brief IS NOT NULL AND target IS NOT NULL)
      SELECT example_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))::DOUBLE, 6) AS jaccard FROM e""",
    "fn_hash_id": "SELECT doc_id, 'doc_' || substr(sha256(concat_ws(chr(31), source, text)), 1, 20) AS content_id FROM documents WHERE text IS NOT NULL",
    "agg_repeat_lines": """WITH l AS (SELECT source, video_id, lower(trim(unnest(string_split(text, chr(10))), ' ')) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
      SELECT source, line, count(DISTINCT video_id) AS videos FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT video_id) >= 2""",
    "agg_phrase_support": """WITH l AS (SELECT doc_id, source, regexp_extract_all(lower(unnest(string_split(text, chr(10)))), '[가-힣A-Za-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
      g AS (SELECT doc_id, source, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 1], ' ') AS phrase FROM (SELECT doc_id, source, w, unnest(range(1, len(w))) AS i FROM l WHERE len(w) >= 2)
        UNION ALL SELECT doc_id, source, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 2], ' ') FROM (SELECT doc_id, source, w, unnest(range(1, len(w) - 1)) AS i FROM l WHERE len(w) >= 3))
      SELECT phrase, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM g GROUP BY phrase HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT source) >= 2""",
    "win_unique_video": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ({_ts('posted_at')} IS NOT NULL) DESC, {_ts('available_at')} DESC NULLS LAST,
        coalesce(channel_id <> '', false) DESC, coalesce(length(description), 0) DESC, card_id) AS n, count(*) OVER (PARTITION BY video_id) AS snapshots FROM video_cards WHERE video_id IS NOT NULL AND video_id <> '')
      SELECT video_id, card_id, snapshots FROM c WHERE n = 1""",
    "win_first_seen": """SELECT card_id, CASE WHEN card_id = min(card_id) OVER (PARTITION BY video_id) THEN 'first' ELSE 'duplicate_video_card' END AS state FROM video_cards WHERE video_id IS NOT NULL""",
    "agg_day_hist": f"""SELECT CAST(CAST({_ts('posted_at')} AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) AS n FROM observations WHERE {_ts('posted_at')} IS NOT NULL GROUP BY 1""",
    "agg_channel_frac": """SELECT source, count(*) FILTER (WHERE regexp_matches(text, '#[가-힣A-Za-z0-9_]+')) AS tagged, count(*) AS docs,
      round(count(*) FILTER (WHERE regexp_matches(text, '#[가-힣A-Za-z0-9_]+')) / count(*)::DOUBLE, 9) AS fraction FROM documents WHERE source IS NOT NULL GROUP BY source""",
    "agg_growth": f"""WITH o AS (SELECT modality, video_id, {_ts('posted_at')} AS t FROM observations WHERE video_id IS NOT NULL), u AS (SELECT * FROM o WHERE t IS NOT NULL),
      a AS (SELECT count(DISTINCT video_id) FILTER (WHERE t <= TIMESTAMPTZ '2023-12-01T00:00:00Z') AS b, count(DISTINCT video_id) FILTER (WHERE t > TIMESTAMPTZ '2023-12-01T00:00:00Z') AS r FROM u),
      m AS (SELECT modality, count(DISTINCT video_id) FILTER (WHERE t <= TIMESTAMPTZ '2023-12-01T00:00:00Z') AS baseline, count(DISTINCT video_id) FILTER (WHERE t > TIMESTAMPTZ '2023-12-01T00:00:00Z') AS recent FROM u GROUP BY modality)
      SELECT modality, baseline, recent, round(recent / nullif(r, 0)::DOUBLE - baseline / nullif(b, 0)::DOUBLE, 9) AS difference FROM m, a""",
    "topk_search_rank": """SELECT query, card_id, search_rank, place FROM (SELECT query, card_id, search_rank, row_number() OVER (PARTITION BY query ORDER BY search_rank, card_id) AS place
      FROM video_cards WHERE query IS NOT NULL AND search_rank IS NOT NULL) WHERE place <= 3""",
}


def queries():
    return {f.__name__: f for f in (
        flt_admit, agg_reason_hist, flt_ts_guard, fn_date_info, fn_char_grams, fn_bigram_jaccard, fn_hash_id,
        agg_repeat_lines, agg_phrase_support, op_metadata_index, agg_score, op_detect_d0, op_detect_d1, win_unique_video, win_first_seen, op_plan_seeds, op_followups,
        op_families, op_rejected, agg_day_hist, agg_channel_frac, agg_growth, topk_search_rank,
    )}


def oracle_sql():
    return {k: v() if callable(v) else v for k, v in SQL.items()}
