"""Queries that show the text functions on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import discovery as D
from quillstream.operators import seeds as S
from quillstream.operators.review import CUES
from quillstream.plans.core_p import _ts
from quillstream.session import table
from quillstream.sources.sinks import report_link


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_cards")


def fn_core_title(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).where("title is not null").select("card_id", T.core_title(F.col("title")).alias("core"))


def fn_norm_nfc(spark: SparkSession, d: str) -> DataFrame:
    titles = _cards(spark, d).where("title is not null").select(T.nfc_casefold(F.col("title")).alias("title"))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def fn_norm_dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creation_examples").where("brief is not null").select("example_id", T.dense(F.col("brief")).alias("brief"))


def fn_norm_copy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").where("content is not null").select("annotation_id", T.copy_form(F.col("content")).alias("content")).distinct()


def fn_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_number"), F.length("line").alias("letters"))


def fn_hashtags(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "observations").where("text is not null").select("input_line", F.explode(T.hashtags(F.col("text"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("input_line").alias("rows"))


def fn_contacts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(T.contacts(F.col("text"))).alias("contact")).groupBy("contact").agg(F.count_distinct("doc_id").alias("docs"))


def fn_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of titles: n-grams of two and three words that hold Hangul, and single Hangul words."""
    segment = T.normalized(F.col("title"))
    uses = _cards(spark, d).where("title is not null").select("card_id", F.explode(T.phrases(segment, 3)).alias("phrase"))
    return uses.groupBy("phrase").agg(F.count_distinct("card_id").alias("cards"))


def fn_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quoted stretches of titles set in quotation marks."""
    return _cards(spark, d).where("title is not null").select("card_id", F.explode(S.quoted_spans(F.concat(F.lit("「"), "title", F.lit("」")))).alias("span"))


def fn_exact_span(spark: SparkSession, d: str) -> DataFrame:
    """Cards that literally hold the query they were found by, case and composition aside."""
    cards = _cards(spark, d).where("query is not null")
    return cards.select("card_id", S.literal_span(F.col("title"), F.col("description"), F.col("query")).alias("literal"))


def fn_cues(spark: SparkSession, d: str) -> DataFrame:
    hits = _cards(spark, d).where("description is not null").select("card_id", F.explode(T.cue_hits(F.col("description"), CUES)).alias("h"))
    return hits.groupBy("card_id", "h.line", "h.cue").agg(F.count(F.lit(1)).alias("n"))


def fn_parody(spark: SparkSession, d: str) -> DataFrame:
    """Cards by whether their text calls it a parody, and whether it says the word at all."""
    text = F.concat_ws("\n", "title", "description")
    return _cards(spark, d).groupBy(T.says_parody(text).alias("parody"), text.rlike(T.PARODY).alias("word")).agg(F.count(F.lit(1)).alias("cards"))


def fn_hostpath(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    return o.groupBy(report_link(F.col("source_url")).isNotNull().alias("linked"), F.try_parse_url("source_url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def fn_retention(spark: SparkSession, d: str) -> DataFrame:
    due = instant("collected_at") + F.make_dt_interval(F.lit(30))
    return table(spark, d, "observations").select("input_line", F.unix_micros(due).cast("string").alias("due_us"))


def fn_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meme_records").select("record_id", T.counted(F.col("version")).alias("number"))


def fn_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(T.canonical_json(F.col("props")).alias("props"))
    return e.groupBy("props").agg(F.count(F.lit(1)).alias("n"))


def fn_mechanical(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as answers that must hold k and may cite keys under 50 only."""
    e = table(spark, d, "events").withColumn("raw", F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.replace("props", F.lit("}"), F.concat(F.lit(', "cites": ["'), (F.col("event_id") % 60).cast("string"), F.lit('"]}')))))
    allowed = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: i.cast("string"))
    return e.select("event_id", T.mechanical(F.col("raw"), ["k"], "cites", allowed).alias("state"))


def fn_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the fields that observations speak for."""
    o = table(spark, d, "observations").where("modality is not null")
    return D.text_lines(o).groupBy("field").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("observation_id").alias("observations"))


def fn_render_text(spark: SparkSession, d: str) -> DataFrame:
    """Each meme's annotations as one text, by role and content."""
    a = table(spark, d, "annotations").where("meme_id is not null and role is not null and content is not null").select("meme_id", "role", "content").distinct()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return a.groupBy("meme_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("text_sha"))


def fn_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Inverse document frequency of character trigrams over all targets."""
    e = table(spark, d, "creation_examples").where("target is not null").select("example_id", F.explode(F.array_distinct(T.char_ngrams(F.col("target"), 3))).alias("term"))
    n = table(spark, d, "creation_examples").where("target is not null").agg(F.count(F.lit(1)).alias("n"))
    df = e.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 9).alias("idf"))  # one row


def flt_secret(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.holds_secret(F.col("text")).alias("secret")).agg(F.count(F.lit(1)).alias("docs"))


def flt_redact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a link of one host, with the host replaced."""
    docs = table(spark, d, "documents").where(F.col("text").contains("clips.example"))
    return docs.select("doc_id", F.sha2(T.redacted(F.col("text"), "clips.example"), 256).alias("sha"))


def op_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.split("text", r"(?<=다\.)\s+")).alias("parts"))


# White space as Unicode has it, and letters of words, for SQL.
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = r"\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"\p{L}\p{M}\p{N}\p{Pc}\x{200c}\x{200d}"
_FOLD = "replace(lower({0}), 'ß', 'ss')"
_CONTACT = rf"(?i)https?://[^{_SPACE}]+|www\.[^{_SPACE}]+|[{_W}.+-]+@[{_W}.-]+\.[A-Za-z]{{2,}}"
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _lines(c: str) -> str:
    return f"regexp_split_to_array(regexp_replace({c}, '(?:{_BREAK})$', ''), '{_BREAK}')"


_CORE = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array(nfc_normalize(title), '[{_SPACE}]+[|｜][{_SPACE}]+')[1], '\\[[^\\]]{{0,80}}\\]|【[^】]{{0,80}}】', ' ', 'g'), '(^|[^{_W}])#[^{_SPACE}]+', '\\1 ', 'g'), '[{_SPACE}]+', ' ', 'g'), ' ')"
_REUSE = CUES.replace("'", "''")

SQL = {
    "fn_core_title": f"SELECT card_id, {_CORE} AS core FROM video_cards WHERE title IS NOT NULL",
    "fn_norm_nfc": f"SELECT {_FOLD.format(f'''trim(regexp_replace(nfc_normalize(title), '[{_WS}]+', ' ', 'g'), ' ')''')} AS title, count(*) AS n FROM video_cards WHERE title IS NOT NULL GROUP BY 1",
    "fn_norm_dense": f"SELECT example_id, {_FOLD.format(f'''regexp_replace(brief, '[{_WS}]+', '', 'g')''')} AS brief FROM creation_examples WHERE brief IS NOT NULL",
    "fn_norm_copy": f"SELECT DISTINCT annotation_id, {_FOLD.format(f'''trim(regexp_replace(trim(translate(content, '，！？：；（）…', ',!?:;()'), ' ' || chr(9) || chr(10) || chr(13) || '\"''“”‘’'), '[{_WS}]+', ' ', 'g'), ' ')''')} AS content FROM annotations WHERE content IS NOT NULL",
    "fn_lines": f"""WITH s AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, i AS line_number, length(l[i]) AS letters FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""",
    "fn_hashtags": f"""WITH t AS (SELECT input_line, unnest(regexp_extract_all(regexp_replace(text, '{_CONTACT}', chr(10), 'g'), '(?:^|[^{_W}#])#([가-힣A-Za-z0-9_]+)', 1)) AS tag FROM observations WHERE text IS NOT NULL)
      SELECT tag, count(*) AS uses, count(DISTINCT input_line) AS rows FROM t GROUP BY tag""",
    "fn_contacts": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CONTACT}')) AS contact FROM documents WHERE text IS NOT NULL)
      SELECT contact, count(DISTINCT doc_id) AS docs FROM t GROUP BY contact""",
    "fn_ngrams": """WITH w AS (SELECT card_id, regexp_extract_all(lower(title), '[가-힣A-Za-z0-9]+') AS w FROM video_cards WHERE title IS NOT NULL),
      g AS (SELECT card_id, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 1], ' ') AS phrase FROM (SELECT card_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
        UNION ALL SELECT card_id, array_to_string(w[CAST(i AS BIGINT):CAST(i AS BIGINT) + 2], ' ') FROM (SELECT card_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
      SELECT phrase, count(DISTINCT card_id) AS cards FROM (SELECT * FROM g WHERE regexp_matches(phrase, '[가-힣]') UNION ALL SELECT card_id, x FROM (SELECT card_id, unnest(w) AS x FROM w) WHERE regexp_full_match(x, '[가-힣]{3,}')) GROUP BY phrase""",
    "fn_quotes": r"""WITH q AS (SELECT card_id, trim(unnest(regexp_extract_all('「' || title || '」', '["“「‘'']([^"”」’''\n]{4,70})["”」’'']', 1)), ' ') AS span FROM video_cards WHERE title IS NOT NULL)
      SELECT card_id, span FROM q WHERE len(regexp_split_to_array(span, '\s+')) >= 2 AND NOT regexp_full_match(span, '(?i)(?:예고|선공개|미방분|스페셜\s*클립|공식|뉴스|속보|shorts?|ep\.?\s*\d+|\d+화)')""",
    "fn_exact_span": f"""SELECT card_id, contains({_FOLD.format(f"trim(regexp_replace(nfc_normalize(concat_ws(chr(10), title, description)), '[{_WS}]+', ' ', 'g'), ' ')")}, {_FOLD.format(f"trim(regexp_replace(nfc_normalize(query), '[{_WS}]+', ' ', 'g'), ' ')")}) AS literal FROM video_cards WHERE query IS NOT NULL""",
    "fn_cues": f"""WITH l AS (SELECT card_id, {_lines('description')} AS l FROM video_cards WHERE description IS NOT NULL), x AS (SELECT card_id, i AS line, l[i] AS t FROM (SELECT card_id, l, unnest(range(1, len(l) + 1)) AS i FROM l))
      SELECT card_id, line, cue, count(*) AS n FROM (SELECT card_id, line, unnest(regexp_extract_all(t, '{_REUSE}')) AS cue FROM x) GROUP BY ALL""",
    "fn_parody": rf"""WITH l AS (SELECT card_id, concat_ws(chr(10), title, description) AS t FROM video_cards), s AS (SELECT card_id, t, {_lines('t')} AS l FROM l)
      SELECT len([x for x in l if regexp_matches(x, '(?i)패러디|parody') AND NOT regexp_matches(x, '(?i)패러디(?:가|는|를)?\s*(?:아니|아닙|아님)|not\s+(?:a\s+)?parody')]) > 0 AS parody, regexp_matches(t, '(?i)패러디|parody') AS word, count(*) AS cards FROM s GROUP BY 1, 2""",
    "fn_hostpath": """SELECT coalesce(regexp_matches(source_url, '^https://(?:www\\.youtube\\.com|youtube\\.com|youtu\\.be|m\\.youtube\\.com)(?:[/:?#]|$)'), false) AS linked, nullif(regexp_extract(source_url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, count(*) AS n FROM observations GROUP BY 1, 2""",
    "fn_retention": f"SELECT input_line, CAST(epoch_us({_ts('collected_at')} + INTERVAL 30 DAYS) AS VARCHAR) AS due_us FROM observations",
    "fn_count": "SELECT record_id, CASE WHEN regexp_full_match(version, '[0-9]+') THEN TRY_CAST(version AS BIGINT) END AS number FROM meme_records",
    "fn_canonical_json": "SELECT CAST(json(props) AS VARCHAR) AS props, count(*) AS n FROM events GROUP BY 1",
    "fn_mechanical": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_object' WHEN event_id % 60 >= 50 THEN 'foreign_citations' ELSE 'ok' END AS state FROM events",
    "fn_fields": f"""WITH o AS (SELECT observation_id, CASE WHEN (lower(modality) = 'video_metadata' OR kind = 'video') AND context.video_title IS NOT NULL THEN [{{'f': 'title', 'v': context.video_title}}, {{'f': 'description', 'v': context.video_description}}]
        WHEN lower(modality) IN ('title', 'description') THEN [{{'f': lower(modality), 'v': text}}] WHEN contains(lower(modality), 'comment') OR kind IN ('comment', 'reply') THEN [{{'f': 'comment', 'v': text}}] ELSE [{{'f': 'text', 'v': text}}] END AS x FROM observations WHERE modality IS NOT NULL),
      f AS (SELECT observation_id, x.f AS field, {_lines('x.v')} AS l FROM (SELECT observation_id, unnest(x) AS x FROM o) WHERE x.v IS NOT NULL)
      SELECT field, CAST(sum(len(l)) AS BIGINT) AS lines, count(DISTINCT observation_id) AS observations FROM f GROUP BY field""",
    "fn_render_text": """WITH a AS (SELECT DISTINCT meme_id, role, content FROM annotations WHERE meme_id IS NOT NULL AND role IS NOT NULL AND content IS NOT NULL)
      SELECT meme_id, sha256(string_agg(role || ': ' || content, chr(10) ORDER BY role, content)) AS text_sha FROM a GROUP BY meme_id""",
    "fn_tfidf": f"""WITH t AS (SELECT example_id, lower(regexp_replace(target, '[{_SPACE}]+', '', 'g')) AS s FROM creation_examples WHERE target IS NOT NULL),
      g AS (SELECT DISTINCT example_id, substr(s, CAST(i AS BIGINT), 3) AS term FROM (SELECT example_id, s, unnest(range(1, length(s) - 1)) AS i FROM t WHERE length(s) >= 3))
      SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)::DOUBLE) + 1, 9) AS idf FROM g GROUP BY term""",
    "flt_secret": r"""SELECT coalesce(regexp_matches(text, '(?i)\bBearer\s+\S+|\bBasic\s+[A-Za-z0-9+/=]+|\bsk-[A-Za-z0-9_-]{12,}|\bAIza[A-Za-z0-9_-]{20,}|-----BEGIN .*PRIVATE KEY-----|https?://[^/\s]+:[^/\s]+@|[?&](?:key|api_key|token|access_token|secret)='), false) AS secret, count(*) AS docs FROM documents GROUP BY 1""",
    "flt_redact": "SELECT doc_id, sha256(replace(text, 'clips.example', '[CREDENTIAL_REDACTED]')) AS sha FROM documents WHERE contains(text, 'clips.example')",
    "op_sentence_split": r"SELECT doc_id, (1 + len(regexp_extract_all(text, '다\.\s+')))::INT AS parts FROM documents WHERE text IS NOT NULL",
}


def queries():
    return {f.__name__: f for f in (
        fn_core_title, fn_norm_nfc, fn_norm_dense, fn_norm_copy, fn_lines, fn_hashtags, fn_contacts, fn_ngrams, fn_quotes, fn_exact_span, fn_cues, fn_parody, fn_hostpath, fn_retention, fn_count,
        fn_canonical_json, fn_mechanical, fn_fields, fn_render_text, fn_tfidf, flt_secret, flt_redact, op_sentence_split,
    )}


def oracle_sql():
    return dict(SQL)
