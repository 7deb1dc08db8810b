"""Discovery of reusable phrases: inverted index, boilerplate, maximal phrases, variants, scored and ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators.components import connected
from quillstream.session import keep, small


def text_lines(observations: DataFrame) -> DataFrame:
    """(observation_id, video_id, channel_id, field, line_number, raw, segments): lines of the fields a row speaks for.

    A video's row speaks for its title and description where its context has a title; title and description rows for
    their text; others for a comment or text. A null text has no lines.
    """
    title, description = F.col("context.video_title"), F.col("context.video_description")
    modality = F.lower("modality")
    one = lambda name, c: F.struct(name.alias("field"), c.alias("value"))
    of_video = F.array(one(F.lit("title"), title), one(F.lit("description"), description))
    comment = modality.contains("comment") | F.coalesce(F.col("kind").isin("comment", "reply"), F.lit(False))
    fields = (
        F.when(((modality == "video_metadata") | (F.col("kind") == "video")) & title.isNotNull(), of_video)
        .when(modality.isin("title", "description"), F.array(one(modality, F.col("text"))))
        .otherwise(F.array(one(F.when(comment, F.lit("comment")).otherwise(F.lit("text")), F.col("text"))))
    )
    long = observations.select("observation_id", "video_id", "channel_id", F.explode(fields).alias("f")).where("f.value is not null")
    numbered = long.select("observation_id", "video_id", "channel_id", "f.field", F.posexplode(T.lines(F.col("f.value"))).alias("n", "raw"))
    composed = numbered.withColumn("raw", T.nfkc(F.col("raw")))
    return composed.select("observation_id", "video_id", "channel_id", "field", (F.col("n") + 1).alias("line_number"), "raw", T.masked_segments(F.col("raw")).alias("segments"))


def repeated_lines(lines: DataFrame, least_videos: int) -> DataFrame:
    """(channel_id, signature): description lines of one channel in at least so many videos."""
    signed = lines.where("field = 'description' and channel_id is not null and channel_id <> '' and size(segments) > 0")
    return (
        signed.groupBy("channel_id", F.xxhash64(F.to_json("segments")).alias("signature"))
        .agg(F.count_distinct("video_id").alias("n"))
        .where(F.col("n") >= least_videos)
        .select("channel_id", "signature")
    )


def line_reasons(lines: DataFrame, least_videos: int = 3) -> DataFrame:
    """lines with `suppressed`: why a description line is no content, the first of production, upload and repeated."""
    repeated = repeated_lines(lines, least_videos).withColumn("repeats", F.lit(True))
    marked = lines.withColumn("signature", F.xxhash64(F.to_json("segments"))).join(repeated, ["channel_id", "signature"], "left")
    described = F.col("field") == "description"
    reason = (
        F.when(described & F.col("raw").rlike(T.PRODUCTION_NOTICE), "production_or_contact_notice")
        .when(described & F.col("raw").rlike(T.UPLOAD_NOTICE), "upload_or_navigation_notice")
        .when(described & F.col("repeats"), "same_channel_repeated_description_line")
    )
    return marked.withColumn("suppressed", reason).drop("signature", "repeats")


def phrase_uses(lines: DataFrame, max_words: int) -> DataFrame:
    """(phrase, observation_id, origin, protected, suppressed): each use of a phrase or tag, once per origin and row."""
    spoken = lines.select("observation_id", F.col("field").alias("origin"), "suppressed", F.explode("segments").alias("segment")).select(
        F.explode(T.phrases(F.col("segment"), max_words)).alias("phrase"), "observation_id", "origin", F.lit(False).alias("protected"), "suppressed"
    )
    tags = lines.select("observation_id", F.explode(T.hashtags(F.col("raw"))).alias("tag")).select(
        T.normalized(F.col("tag")).alias("phrase"), "observation_id", F.lit("hashtag").alias("origin"), F.lit(True).alias("protected"), F.lit(None).cast("string").alias("suppressed")
    ).where(F.col("phrase").rlike(T.HANGUL))
    return spoken.unionByName(tags).distinct()


def maximal(index: DataFrame, max_words: int = 64) -> DataFrame:
    """Of phrases with equal support, those no longer one contains; protected ones stay.

    index: (phrase, protected, signature) with the signature of the set of supporting rows. Containment is transitive, so
    any longer phrase serves. A phrase is found inside longer ones by its own text: every longer phrase of a group
    lists its inner phrases, which are then struck off by an equi-join, not by comparing all pairs of the group.
    """
    words = F.split("phrase", " ")
    inner = index.where(F.size(words) > 1).select("signature", F.explode(T.word_ngrams(words, 1, max_words)).alias("inner"), "phrase").where("inner <> phrase").select("signature", F.col("inner").alias("phrase")).distinct()
    plain, kept = index.where("not protected"), index.where("protected")
    return plain.join(inner, ["signature", "phrase"], "left_anti").unionByName(kept)


def variant_edges(nodes: DataFrame) -> DataFrame:
    """(left, right, sequence_similarity, character_bigram_jaccard, shared_tokens): similar phrases, left < right.

    Phrases of three words or more that share their first or last word are compared, behind cheap tests of length and
    shared words. The nodes are a top list of the index, which bounds the pairs.
    """
    split = nodes.select("phrase", F.split("phrase", " ").alias("w")).where("size(w) >= 3")
    keys = split.select("phrase", "w", F.explode(F.array(F.concat(F.lit("s "), F.element_at("w", 1)), F.concat(F.lit("e "), F.element_at("w", -1)))).alias("block"))
    a, b = (keys.select("block", F.col("phrase").alias(n), F.col("w").alias(f"w_{n}")) for n in ("left", "right"))
    pairs = (
        a.join(b, "block")
        .where("left < right and abs(size(w_left) - size(w_right)) <= 1 and size(array_intersect(w_left, w_right)) >= 2")
        .where(~T.contains_words(F.col("right"), F.col("left")) & ~T.contains_words(F.col("left"), F.col("right")))
        .withColumn("jaccard", T.bigram_jaccard(F.col("left"), F.col("right")))
        .where("jaccard >= 0.4")
        .select("left", "right", "jaccard", F.array_sort(F.array_intersect("w_left", "w_right")).alias("shared_tokens"))
        .dropDuplicates(["left", "right"])
    )
    return (
        pairs.withColumn("ratio", T.sequence_ratio(F.col("left"), F.col("right"))).where("ratio >= 0.72")
        .select("left", "right", F.round("ratio", 4).alias("sequence_similarity"), F.round("jaccard", 4).alias("character_bigram_jaccard"), "shared_tokens")
    )


def detect(
    observations: DataFrame, *, method: str = "D0", min_documents: int = 2, min_videos: int = 2, max_words: int = 6,
    max_candidates: int = 100, max_phrase_nodes: int = 3000, least_repeats: int = 3, baseline_end: str | None = None,
) -> DataFrame:
    """Ranked candidates of admitted observations (as admit() leaves them, one provenance).

    D0 takes each phrase alone; D1 joins similar phrases into clusters and ranks content before tags. max_phrase_nodes
    and max_candidates are the operator's top lists. Rows with null channels count without channel; no rows give none.
    """
    obs = keep(
        observations.select(
            "observation_id", F.xxhash64(F.lower("platform"), F.col("source_id")).alias("source"), "video_id", "channel_id",
            F.xxhash64("normalized").alias("content"), F.to_date(instant("posted_at")).alias("day"), instant("available_at").alias("available"),
            instant("posted_at").alias("posted"),
        )
    )
    lines = line_reasons(text_lines(observations), least_repeats)
    uses = keep(phrase_uses(lines, max_words))
    live = uses.where("suppressed is null")
    # each phrase's supporting rows once; their set, as its size and two order-free sums of hashes
    support = keep(live.groupBy("phrase", "observation_id").agg(F.max("protected").alias("protected")))
    counted = support.groupBy("phrase").agg(
        F.max("protected").alias("protected"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("observation_id").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(7), "observation_id").cast("decimal(38,0)")).alias("h2"),
    )
    if method == "D0":  # a phrase alone: what fewer rows hold than sources are needed neither counts nor makes others inner ones
        counted = counted.where(F.col("n") >= min_documents)
    index = maximal(counted.select("phrase", "protected", F.xxhash64("n", "h1", "h2").alias("signature")), max(max_words, 64)).select("phrase")
    in_obs = support.join(index, "phrase", "left_semi").join(obs.select("observation_id", "source", "video_id"), "observation_id")
    ordered = in_obs.groupBy("phrase").agg(F.count_distinct("source").alias("docs"), F.count_distinct("video_id").alias("videos"), F.count(F.lit(1)).alias("rows"))
    if method == "D0":  # a phrase alone: too little support can be dropped before the top list, which puts it last anyway
        ordered = ordered.where((F.col("docs") >= min_documents))
    nodes = keep(ordered.orderBy(F.desc("docs"), F.desc(F.length("phrase")), "phrase").limit(max_phrase_nodes))
    if method == "D1":
        edges = keep(variant_edges(nodes))
        labels = connected(edges.select(F.col("left").alias("a"), F.col("right").alias("b")))
        members = nodes.join(labels.withColumnRenamed("node", "phrase"), "phrase", "left").select("phrase", "rows", F.coalesce("root", "phrase").alias("cluster"))
        linked = edges.join(labels, edges["left"] == labels["node"]).groupBy(F.col("root").alias("cluster")).agg(F.count(F.lit(1)).alias("edges"))
    else:
        members = nodes.select("phrase", "rows", F.col("phrase").alias("cluster"))
        linked = None
    members = keep(members)
    named = small(members.select("phrase", "cluster"), max_phrase_nodes, 512)
    # once per cluster, row and origin; everything else follows from the row
    evidence = keep(live.join(named, "phrase").select("cluster", "observation_id", "origin").distinct().join(obs, "observation_id"))
    sources = obs.agg(F.count_distinct("source").alias("all_sources"))
    source_if = lambda origin: F.count_distinct(F.when(F.col("origin") == origin, F.col("source")))
    scores = evidence.groupBy("cluster").agg(
        F.count_distinct("source").alias("source_document_frequency"), F.count_distinct("video_id").alias("source_video_count"),
        F.count_distinct("content").alias("distinct_observed_content_count"), F.count_distinct("observation_id").alias("observation_count"),
        F.count_distinct("channel_id").alias("channel_count"), source_if("title").alias("title_support"), source_if("hashtag").alias("hashtag_support"),
        source_if("description").alias("description_support"), F.min("available").alias("first_observed_available_at"), F.max("available").alias("last_observed_available_at"),
        *([
            F.count_distinct(F.when(F.col("posted") <= F.lit(baseline_end).cast("timestamp"), F.col("source"))).alias("baseline_document_count"),
            F.count_distinct(F.when(F.col("posted") > F.lit(baseline_end).cast("timestamp"), F.col("source"))).alias("recent_document_count"),
        ] if baseline_end else []),
    ).where((F.col("source_document_frequency") >= min_documents) & (F.col("source_video_count") >= min_videos))
    forms = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("surface_form_count"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("r"), (-F.length("phrase")).alias("l"), "phrase"))), lambda x: x["phrase"]).alias("surface_forms"),
    )
    boiler = uses.where("suppressed is not null").join(named, "phrase").join(obs, "observation_id").groupBy("cluster").agg(F.count_distinct("source").alias("boilerplate_support_excluded"))
    channel_videos = obs.where("channel_id is not null").groupBy("channel_id").agg(F.count_distinct("video_id").alias("of"))
    tagged = evidence.where("channel_id is not null").groupBy("cluster", "channel_id").agg(F.count_distinct(F.when(F.col("origin") == "hashtag", F.col("video_id"))).alias("videos"))
    ubiquity = tagged.join(channel_videos, "channel_id").groupBy("cluster").agg(F.min(F.col("videos") / F.col("of")).alias("least_fraction"))
    out = scores.join(forms, "cluster").join(boiler, "cluster", "left").join(ubiquity, "cluster", "left")
    out = out.join(linked, "cluster", "left") if linked is not None else out.withColumn("edges", F.lit(0))
    only_tags = (F.col("hashtag_support") > 0) & (F.col("title_support") == 0) & (F.col("hashtag_support") == F.col("source_document_frequency")) & (F.coalesce("least_fraction", F.lit(0.0)) >= 0.8)
    out = out.select(
        T.hash_id("qsc_", F.array_join(F.array_sort("surface_forms"), "\u001e")).alias("candidate_id"), F.element_at("surface_forms", 1).alias("representative_phrase"),
        *[c for c in scores.columns if c != "cluster"], "surface_form_count", F.coalesce("edges", F.lit(0)).alias("possible_variant_edge_count"),
        F.coalesce("boilerplate_support_excluded", F.lit(0)).alias("boilerplate_support_excluded"), only_tags.alias("ubiquitous_hashtag_only"), "surface_forms",
    ).withColumn("content_priority", F.when(F.col("title_support") > 0, 2).when(F.col("ubiquitous_hashtag_only"), 0).otherwise(1))
    keys = ["source_document_frequency", "source_video_count"] if method == "D0" else [
        "content_priority", "title_support", "channel_count", "distinct_observed_content_count", "possible_variant_edge_count", "source_video_count",
    ]
    out = out.crossJoin(F.broadcast(sources)).withColumn("source_fraction", F.try_divide("source_document_frequency", "all_sources")).drop("all_sources")  # one row
    top = out.orderBy(*[F.desc(k) for k in keys], "candidate_id").limit(max_candidates)
    return top
