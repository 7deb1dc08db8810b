"""Seeds, follow-ups and families of expressions, from titles of collected videos."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators.admission import first_reason
from quillstream.operators.selection import top_per_group
from quillstream.session import keep, small

# Patterns of news, cues of reuse, deictic references, quoted spans, boilerplate and the comparison form.
NEWS = r"\[?(?:속보|단독|뉴스|긴급속보)\]?|금리\s*(?:인상|인하)|증시\s*(?:마감|개장)|(?:정부|대통령|장관).{0,15}(?:발표|회의|브리핑)|사망자\s*\d"
REUSE_CUE = r"(?i)패러디|밈|따라\s*(?:해|하|했)|인용|모사|parody|\bmeme\b|\bremix\b"
GENERIC_REFERENCE = r"^(?:그|이|저|이런|그런|저런|어떤)\s*(?:효과음|음악|소리|노래|장면|영상|사진|짤|캐릭터|춤|밈)$"
QUOTED = r"[\"“「‘']([^\"”」’'\n]{4,70})[\"”」’']"
BOILERPLATE = r"(?i)^(?:예고|선공개|미방분|스페셜\s*클립|공식|뉴스|속보|shorts?|ep\.?\s*\d+|\d+화)$"
COMPARISON = r"^(.+)(?:은|는|이|가)\s+(.+?)(?:과|와)\s+(구분|구별)(?:할|될|하기)?\s*수(?:가)?\s*없(?:다|음|어|습니다|네|죠)?[.!?…]*$"
MODIFIER_END = r"(?:한|하는|된|되는|진|지는|운|우는|었던|였던|같은|없는|있는)$"
#: Rows of a seed's fresh and of its known channels that its picks are chosen from.
SHORT_LIST = 200
#: Scores of the kinds of seeds, for ordering only.
SCORES = {"sentence_comparison": 12, "orthographic_wordplay": 8, "repeated_catchphrase": 7, "quoted_expression": 6, "rhetorical_catchphrase": 6, "source_labelled_reuse": 5}


def unique_videos(rows: DataFrame, order: str) -> DataFrame:
    """One row per video: the one with a usable posted_at, then the latest available, with a channel, with the longest
    description; ties go to the first in `order`. Null videos are left out. Combined before the shuffle."""
    best = F.struct(
        instant("posted_at").isNotNull().alias("p"), instant("available_at").alias("a"), F.coalesce(F.col("channel_id") != "", F.lit(False)).alias("c"),
        F.coalesce(F.length("description"), F.lit(0)).alias("d"), (-F.col(order)).alias("o"),
    )
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.where("video_id is not null and video_id <> ''").groupBy("video_id").agg(F.max_by(columns, best).alias("row"), F.count(F.lit(1)).alias("snapshots")).select("row.*", "snapshots")


def quoted_spans(title):
    """Quoted stretches of two words or more that are no boilerplate."""
    spans = F.transform(F.regexp_extract_all(title, F.lit(QUOTED), F.lit(1)), lambda q: F.trim(q))
    return F.filter(spans, lambda q: (F.size(F.split(q, r"\s+")) >= 2) & ~q.rlike(BOILERPLATE))


def literal_span(title, description, query):
    """Whether a title or description literally holds a span, composition, case and white space aside."""
    return T.nfc_casefold(F.concat_ws("\n", title, description)).contains(T.nfc_casefold(query))


def comparison_frame(core):
    """struct(prefix, left, right, frame_key) of a title of the form '<modifier> A is not to be told from B', else null."""
    subject, target = F.trim(F.regexp_extract(core, COMPARISON, 1)), F.trim(F.regexp_extract(core, COMPARISON, 2))
    words = F.split(subject, r"\s+")
    at = F.array_max(F.filter(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.when(w.rlike(MODIFIER_END), i + 1).otherwise(0)), lambda i: i > 0))
    prefix, left = F.array_join(F.slice(words, 1, at), " "), F.array_join(F.slice(words, at + 1, F.size(words)), " ")
    ok = core.rlike(COMPARISON) & at.isNotNull() & (left != "") & (target != "") & (F.length(prefix) >= 4)
    return F.when(ok, F.struct(prefix.alias("prefix"), left.alias("left"), target.alias("right"), F.concat(F.lower(prefix), F.lit("|indistinguishable")).alias("frame_key")))


def proposals(videos: DataFrame) -> DataFrame:
    """(key, seed_id, query, kind, score, video_id, channel_id): spans of six kinds that literally occur in their title or
    description; key is the span composed and case-folded. Titles of news propose nothing."""

    @F.pandas_udf("array<struct<span:string,kind:string>>")
    def words_of(core: pd.Series) -> pd.Series:
        out = []
        for c in core:
            found = []
            spans = list(re.finditer(r"[가-힣A-Za-z0-9]+", c or ""))
            for x, y in zip(spans, spans[1:]):
                a, b = x.group(), y.group()
                if a == b and len(a) >= 3:
                    found.append({"span": c[x.start() : y.end()], "kind": "repeated_catchphrase"})
                elif 3 <= len(a) <= 16 and 3 <= len(b) <= 16 and a != b and 0.70 <= SequenceMatcher(None, a.casefold(), b.casefold()).ratio() < 1:
                    found.append({"span": b, "kind": "orthographic_wordplay"})
            out.append(found)
        return pd.Series(out)

    base = videos.where("title is not null").withColumn("core", T.core_title(F.col("title"))).where(~F.col("title").rlike(NEWS))
    one = lambda span, kind: F.struct(span.alias("span"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<span:string,kind:string>>")
    core = F.col("core")
    quotes = quoted_spans(F.col("title"))
    commas = F.length(core) - F.length(F.replace(core, F.lit(","), F.lit("")))
    enumerated = (commas >= 2) & F.length(core).between(8, 65) & core.rlike("(?:하다|이다|야|해|다)[.!?…☆]*$")
    labelled = core.rlike(REUSE_CUE) & F.length(core).between(3, 55) & ~core.rlike(BOILERPLATE)
    proposals = base.withColumn(
        "proposal",
        F.explode(F.concat(
            F.when(comparison_frame(core).isNotNull(), F.array(one(comparison_frame(core)["prefix"], "sentence_comparison"))).otherwise(none),
            words_of(core),
            F.transform(quotes, lambda q: one(q, "quoted_expression")),
            F.when(enumerated, F.array(one(F.regexp_replace(core, "[.☆ ]+$", ""), "rhetorical_catchphrase"))).otherwise(none),
            F.when(labelled, F.array(one(core, "source_labelled_reuse"))).otherwise(none),
        )),
    ).select("video_id", "channel_id", "title", "description", F.col("proposal.span").alias("query"), F.col("proposal.kind").alias("kind"))
    key = T.nfc_casefold(F.col("query"))
    score = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])[F.col("kind")] + F.when((F.col("kind") == "quoted_expression") & F.col("title").rlike(REUSE_CUE), 1).otherwise(0)
    literal = literal_span(F.col("title"), F.col("description"), F.col("query"))
    seeds = proposals.where(literal).withColumn("key", key).where("key <> ''").where(~F.col("key").rlike(GENERIC_REFERENCE)).withColumn("score", score)
    seeds = seeds.withColumn("seed_id", T.hash_id("qsd_", F.col("key"), F.col("kind")))
    return seeds.select("key", "seed_id", "query", "kind", "score", "video_id", "channel_id")


def plan_seeds(videos: DataFrame, max_seeds: int | None) -> DataFrame:
    """(seed_id, query, kind, score, videos, channels, key): equal spans merged into the one of the best score, with how many
    videos and channels propose them.

    max_seeds is the operator's top list; None gives all seeds, in no order.
    """
    merged = proposals(videos).groupBy("key").agg(
        F.min_by(F.struct("seed_id", "query", "kind", "score"), F.struct((-F.col("score")).alias("s"), "seed_id", "query")).alias("best"),
        F.count_distinct("video_id").alias("videos"), F.count_distinct("channel_id").alias("channels"),
    )
    seeds = merged.select("best.*", "videos", "channels", "key")
    return seeds if max_seeds is None else seeds.orderBy(F.desc("score"), "seed_id").limit(max_seeds)


def holding(videos: DataFrame, seeds: DataFrame) -> DataFrame:
    """videos with `body` (title and description, case folded), joined with the seeds they literally hold; the seeds are a top
    list, broadcast where its counted size allows."""
    named = keep(seeds.select("seed_id", "key"))
    return videos.drop("seed_id", "key", "span", "seed_kind").withColumn("body", T.nfc_casefold(F.concat_ws("\n", "title", "description"))).join(small(named, named.count(), 256), F.col("body").contains(F.col("key")))


def followups(seeds: DataFrame, videos: DataFrame, limit: int = 3) -> DataFrame:
    """(seed_id, video_id, place): up to `limit` varied videos per seed that hold its span but don't propose it, picked greedily.

    Each pick favours a new channel and a new title; a seen title is passed over. Per seed, title and channel only the best row
    can be picked, and of one channel only its `limit` + 1 best; of the rest, only those enter that can beat what the best
    rows of all channels score without favour. What a seed's picks are chosen from is then a short list.
    """
    from pyspark.sql import Window

    sources = keep(proposals(videos).join(seeds.select("key", F.col("seed_id").alias("sid")), "key").select(F.col("sid").alias("seed_id"), "video_id", "channel_id").distinct())
    rows = videos.where(F.col("video_id").rlike("^[A-Za-z0-9_-]{11}$")).where(~F.col("title").rlike(NEWS) | F.col("title").rlike(REUSE_CUE))
    hits = holding(rows, seeds).join(sources.select("seed_id", "video_id").distinct(), ["seed_id", "video_id"], "left_anti")
    known = sources.where("channel_id <> ''").select("seed_id", F.col("channel_id").alias("channel")).distinct().withColumn("known", F.lit(True))
    hits = hits.select(
        "seed_id", "video_id", F.coalesce("channel_id", F.lit("")).alias("channel"), T.nfc_casefold(T.core_title(F.col("title"))).alias("title_key"), F.coalesce("search_rank", F.lit(100000)).alias("rank"),
        (F.lit(4.0) + F.when(F.col("body").rlike(REUSE_CUE), 5).otherwise(0) + F.least(F.coalesce(F.length("description"), F.lit(0)) / 50, F.lit(2.0)) + F.when(F.col("channel_id") != "", 2).otherwise(0)).alias("score"),
    ).join(known, ["seed_id", "channel"], "left").withColumn("fresh", (F.col("channel") != "") & F.col("known").isNull())
    order = F.struct("score", (-F.col("rank")).alias("r"), "video_id")
    best = hits.groupBy("seed_id", "title_key", "channel", "fresh").agg(F.max_by(F.struct("video_id", "score", "rank"), order).alias("x")).select("seed_id", "title_key", "channel", "fresh", "x.*")
    ordered = [F.desc("score"), F.col("rank"), F.desc("video_id")]
    per_channel = best.withColumn("n", F.row_number().over(Window.partitionBy("seed_id", "channel").orderBy(*ordered))).where(F.col("n") <= limit + 1).drop("n")
    # a title and a fresh channel add 8 at most: of each seed's fresh and known channels, the first of many titles suffice
    short = top_per_group(per_channel, ["seed_id", "fresh"], ordered, SHORT_LIST, F.col("video_id"), "n").drop("n")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.to_dict("records")
        channels, titles, out = set(), set(), []
        while left and len(out) < limit:
            item = max(left, key=lambda r: (r["score"] + 5 * (r["fresh"] and r["channel"] not in channels) + 3 * (r["title_key"] not in titles), -r["rank"], r["video_id"]))
            left.remove(item)
            if item["title_key"] in titles:
                continue
            out.append((item["seed_id"], item["video_id"], len(out) + 1))
            channels.add(item["channel"])
            titles.add(item["title_key"])
        return pd.DataFrame(out, columns=["seed_id", "video_id", "place"])

    return short.groupBy("seed_id").applyInPandas(pick, "seed_id string, video_id string, place int")


def usable(videos: DataFrame) -> DataFrame:
    """videos with `left_out`: why a video is no evidence for a family, null where it is."""
    return videos.withColumn("left_out", first_reason(
        (instant("posted_at").isNull() | instant("available_at").isNull(), "exact_publication_or_observation_time_missing"),
        (F.col("title").rlike(NEWS) & ~F.col("title").rlike(REUSE_CUE), "news_or_topic_title_without_reuse_evidence"),
    ))


def _counts(uses: DataFrame, keys: list[str], varies) -> DataFrame:
    """Per family: titles, videos, channels, distinct contents of its slots, and videos with a cue of reuse or of parody."""
    return uses.groupBy(*keys).agg(
        F.count_distinct(T.nfc_casefold(T.core_title(F.col("title")))).alias("titles"), F.count_distinct("video_id").alias("videos"), F.count_distinct("channel_id").alias("channels"), F.count_distinct(varies).alias("variants"),
        F.count_if(F.concat_ws("\n", "title", "description").rlike(REUSE_CUE)).alias("cues"), F.count_if(T.says_parody(F.concat_ws("\n", "title", "description"))).alias("parodies"),
    )


def families(seeds: DataFrame, videos: DataFrame) -> DataFrame:
    """(family_id, seed_id, label, kind, titles, videos, channels, variants, cues, status): families of expressions and what
    supports them.

    sentence_comparison: titles of one comparison frame, supported by two videos with different arguments and two channels.
    repeated_catchphrase: a seed's word said twice around different words, two of them, in two channels; such a seed has no
    other family. Else, by literal use: source_declared_parody or expression_reuse, supported by two titles, two channels
    and a cue of reuse, unless the expression only points at something. Videos without usable times, and news, support none.
    """
    good = keep(usable(videos).where("left_out is null").drop("left_out"))
    frame = comparison_frame(T.core_title(F.col("title")))
    framed = good.withColumn("f", frame).where("f is not null").withColumn("label", F.concat("f.prefix", F.lit(" {} / {}"))).withColumn("key", F.col("f.frame_key"))
    framed = _counts(framed, ["key"], F.struct("f.left", "f.right")).select("*", F.lit("sentence_comparison").alias("kind"), F.lit(None).cast("string").alias("seed_id"), F.regexp_replace("key", r"\|indistinguishable$", "").alias("label"))
    framed = framed.withColumn("status", (F.col("variants") >= 2) & (F.col("channels") >= 2))
    plain = keep(seeds.where("kind <> 'sentence_comparison'").select("seed_id", "key", F.col("query").alias("span"), F.col("kind").alias("seed_kind")))
    uses = keep(holding(good, plain).join(plain.select("seed_id", "span", "seed_kind"), "seed_id").withColumn("middle", F.when(F.col("seed_kind") == "repeated_catchphrase", T.nfc_casefold(T.repeated_frame(F.col("title"), F.col("span"))["middle"]))))
    said = _counts(uses.where("middle is not null"), ["seed_id", "key", "span"], F.col("middle")).where("variants >= 2 and channels >= 2")
    said = said.select("*", F.lit("repeated_catchphrase").alias("kind"), F.col("span").alias("label"), F.lit(True).alias("status"))
    literal = _counts(uses.join(said.select("seed_id"), "seed_id", "left_anti"), ["seed_id", "key", "span"], F.lit(1))
    literal = literal.select("*", F.when(F.col("parodies") > 0, "source_declared_parody").otherwise("expression_reuse").alias("kind"), F.col("span").alias("label"),
                             ((F.col("titles") >= 2) & (F.col("channels") >= 2) & (F.col("cues") > 0) & ~F.col("key").rlike(GENERIC_REFERENCE)).alias("status"))
    columns = ["key", "seed_id", "label", "kind", "titles", "videos", "channels", "variants", "cues", "status"]
    every = framed.select(*columns).unionByName(said.select(*columns)).unionByName(literal.select(*columns))
    return every.select(
        T.hash_id("qsf_", F.col("kind"), F.col("key")).alias("family_id"), "seed_id", "label", "kind", "titles", "videos", "channels", "variants", "cues",
        F.when(F.col("status"), "supported_textual_reuse").otherwise("needs_evidence").alias("status"),
    )


def rejected(seeds: DataFrame, videos: DataFrame) -> DataFrame:
    """(item, reason): videos that are no evidence or in no family, seeds without evidence, and seeds that only point at
    something, each with its reason."""
    marked = keep(usable(videos))
    good = marked.where("left_out is null").drop("left_out")
    out = marked.where("left_out is not null").select(F.col("video_id").alias("item"), F.col("left_out").alias("reason"))
    plain = keep(seeds.where("kind <> 'sentence_comparison'").select("seed_id", "key"))
    held = keep(holding(good, plain).select("seed_id", "video_id").distinct())
    bare = plain.join(held.select("seed_id").distinct(), "seed_id", "left_anti").select(F.col("seed_id").alias("item"), F.lit("no_timestamped_literal_evidence_for_seed").alias("reason"))
    pointing = plain.where(F.col("key").rlike(GENERIC_REFERENCE)).select(F.col("seed_id").alias("item"), F.lit("generic_deictic_media_reference_shared_referent_unknown").alias("reason"))
    framed = good.where(comparison_frame(T.core_title(F.col("title"))).isNotNull()).select("video_id")
    none = good.select("video_id").distinct().join(held.select("video_id").unionByName(framed).distinct(), "video_id", "left_anti").select(F.col("video_id").alias("item"), F.lit("no_supported_reusable_form_detected").alias("reason"))
    return out.unionByName(bare).unionByName(pointing).unionByName(none)
