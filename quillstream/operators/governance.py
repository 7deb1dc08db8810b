"""Governed records: snapshots with all that hangs on them, their export, support against evaluation, ties, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import temporal as P
from quillstream.operators.admission import first_reason

# Classes of provenance, modalities, kinds of authors whose knowledge is automatic.
PROVENANCE = ("actual_collected", "researcher_authored", "ai_synthetic")
MODALITIES = ("text", "image", "audio", "video")
AUTOMATIC = ("ai", "system")


def visible_by(at: str, available: str = "available_at", published: str | None = None) -> Column:
    """Whether a row is available and, where it says so, published by a time; a time that can't be used makes it invisible."""
    when = F.lit(at).cast("timestamp")
    known = F.coalesce(instant(available) <= when, F.lit(False))
    return known if published is None else known & (F.col(published).isNull() | F.coalesce(instant(published) <= when, F.lit(False)))


def snapshot(records: DataFrame, annotations: DataFrame, examples: DataFrame, key: Column, at: str, order: Column) -> dict[str, DataFrame]:
    """What is known at a time: records, assets, relations, annotations, examples.

    records: the latest revision of each key with its columns and `key`. assets: (key, asset_id, parents), those of the
    revisions visible by then. relations: (key, asset_id, parent), parents that are selected themselves. annotations and
    examples: the visible ones whose `key` column is selected. Rows without a key hang on nothing.
    """
    chosen = P.latest_as_of(records, key, at, order).withColumn("key", key)
    assets = chosen.select("key", F.explode(P.visible(F.col("assets"), at)).alias("a")).where("a.asset_id is not null")
    assets = assets.select("key", F.col("a.asset_id").alias("asset_id"), F.col("a.parent_asset_ids").alias("parents"))
    links = assets.select("key", "asset_id", F.explode(F.array_distinct("parents")).alias("parent")).distinct()
    keys = chosen.select("key").distinct()
    return {
        "records": chosen, "assets": assets,
        "relations": links.join(assets.select(F.col("asset_id").alias("parent")).distinct(), "parent", "left_semi"),
        "annotations": annotations.where(visible_by(at)).join(keys, "key", "left_semi"),
        "examples": examples.where(visible_by(at)).join(keys, "key", "left_semi"),
    }


def counted_by(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, assets, relations, annotations, examples): how much of each part hangs on each record of a snapshot."""
    ids = {"assets": "asset_id", "relations": F.struct("asset_id", "parent"), "annotations": "annotation_id", "examples": "example_id"}
    out = parts["records"].select("key")
    for name, each in ids.items():
        out = out.join(parts[name].groupBy("key").agg(F.count_distinct(each).alias(name)), "key", "left")
    return out.select("key", *[F.coalesce(n, F.lit(0)).alias(n) for n in ids])


def routed(examples: DataFrame, split: Column) -> DataFrame:
    """(example_id, route, text_sha): where each example's texts go.

    Training examples are contexts as a whole; of evaluation examples the brief is an input and the target is held apart;
    examples without a split or a purpose are excluded.
    """
    part = lambda name, text: F.struct(F.lit(name).alias("route"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha"))
    both = F.concat_ws("\u001f", "brief", "target")
    routes = (
        F.when(split.isNull(), F.array(part("excluded_no_split", F.lit(""))))
        .when(F.col("purpose").isNull(), F.array(part("excluded_no_purpose", F.lit(""))))
        .when(split == "train", F.array(part("context", both)))
        .otherwise(F.array(part("evaluation_input", F.col("brief")), part("evaluation_target", F.col("target"))))
    )
    return examples.select("example_id", F.explode(routes).alias("r")).select("example_id", "r.*").distinct()


def two_axis(examples: DataFrame, known: DataFrame, support_at: str, evaluate_at: str) -> DataFrame:
    """(example_id, state): training examples known by the support time are contexts; dev and test examples of a later time are
    evaluated unless the first of these applies: not_available (no usable time, or after the evaluation time),
    before_support, record_unknown (no record known by the support time), same_example_identity, same_content.

    examples: (key, example_id, split, brief, target, available_at); known: (key) of the records known by the support time.
    Training examples of another time, and examples without a split, are no part of either.
    """
    low, high, at = F.lit(support_at).cast("timestamp"), F.lit(evaluate_at).cast("timestamp"), instant("available_at")
    e = examples.select(
        F.col("key").alias("entity"), "example_id", "split", at.alias("at"), *[F.sha2(T.dense(F.col(c)), 256).alias(f"{c}_sha") for c in ("brief", "target")],
    ).where("example_id is not null")
    k = known.select(F.col("key").alias("entity")).distinct()
    context = e.where((F.col("split") == "train") & (F.col("at") <= low)).join(k, "entity", "left_semi")
    asked = e.where(F.col("split").isin("dev", "test")).join(k.withColumn("known", F.lit(True)), "entity", "left")
    exposed = P.exposure_conflicts(asked, context).select("example_id", F.col("reason").alias("exposed"))
    state = first_reason(
        (F.col("at").isNull() | (F.col("at") > high), "not_available"), (F.col("at") <= low, "before_support"), (F.col("known").isNull(), "record_unknown"), (F.col("exposed").isNotNull(), "exposed"),
    )
    state = F.when(state == "exposed", F.col("exposed")).otherwise(F.coalesce(state, F.lit("evaluated")))
    judged = asked.join(exposed, "example_id", "left").select("example_id", state.alias("state"))
    return context.select("example_id", F.lit("context").alias("state")).unionByName(judged).distinct()


def tie_edges(records: DataFrame, entity: Column, named) -> DataFrame:
    """(a, b): what ties records: family, source group, asset, the place its content lies, and an asset's parents.

    Nodes carry the kind of thing they name; `named` cleans an id and makes those that name nothing null.
    """
    r = records.select(entity.alias("m"), named(F.col("family_id")).alias("f"), F.col("assets")).where("m is not null")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    a = r.select("m", F.explode("assets").alias("a")).select(
        "m", named(F.col("a.source_group_id")).alias("g"), named(F.col("a.asset_id")).alias("id"), F.trim("a.source_url").alias("url"), F.col("a.parent_asset_ids").alias("parents")
    )
    parents = a.where("id is not null").select("id", F.explode("parents").alias("p")).select("id", named(F.col("p")).alias("p"))
    parts = [
        r.where("f is not null").select(node(0, F.col("m")).alias("a"), node(1, F.col("f")).alias("b")),
        a.where("g is not null").select(node(0, F.col("m")).alias("a"), node(2, F.col("g")).alias("b")),
        a.where("id is not null").select(node(0, F.col("m")).alias("a"), node(3, F.col("id")).alias("b")),
        a.where("url <> ''").select(node(0, F.col("m")).alias("a"), node(4, F.col("url")).alias("b")),
        parents.where("p is not null").select(node(3, F.col("id")).alias("a"), node(3, F.col("p")).alias("b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def content_edges(assets: DataFrame) -> DataFrame:
    """(parent, child): assets of the same content lead to each other, by way of a node of the content itself."""
    there = assets.where("content is not null and asset_id is not null").select(F.col("asset_id").alias("parent"), F.concat(F.lit("content:"), "content").alias("child"))
    return there.unionByName(there.select(F.col("child").alias("parent"), F.col("parent").alias("child"))).distinct()


def record_rules() -> dict[str, Column]:
    """Rules of one record and its assets; a condition that is true is broken."""
    known, public, assets = instant("available_at"), instant("published_at"), F.col("assets")
    ids = F.transform(assets, lambda a: a["asset_id"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    any_asset = lambda f: F.coalesce(F.exists(assets, f), F.lit(False))
    return {
        "meme_id": blank(F.col("meme_id")), "family_id": F.col("family_id").isNull(), "title": blank(F.col("title")), "platform": blank(F.col("platform")),
        "version": ~F.coalesce(F.col("version").rlike("^[0-9]+$"), F.lit(False)), "provenance": ~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)),
        "split": F.col("split").isNotNull() & ~F.col("split").isin("train", "dev", "test"), "available_at": known.isNull(), "published_at": F.col("published_at").isNotNull() & public.isNull(),
        "published_after_available": public > known, "no_asset": F.coalesce(F.size(assets), F.lit(0)) <= 0, "repeated_asset": F.size(F.array_distinct(ids)) < F.size(ids),
        "asset_id": any_asset(lambda a: blank(a["asset_id"])), "asset_group": any_asset(lambda a: blank(a["source_group_id"])), "asset_url": any_asset(lambda a: ~F.coalesce(a["source_url"].startswith("https://"), F.lit(False))),
        "asset_modality": any_asset(lambda a: ~F.coalesce(a["modality"].isin(*MODALITIES), F.lit(False))), "asset_license": any_asset(lambda a: blank(a["license_or_use_basis"])),
        "asset_missing": any_asset(lambda a: ~F.coalesce(a["status"] == "ok", F.lit(False))), "asset_time": any_asset(lambda a: instant(a["available_at"]).isNull()),
        "asset_published_time": any_asset(lambda a: a["published_at"].isNotNull() & instant(a["published_at"]).isNull()),
        "asset_before_record": any_asset(lambda a: instant(a["available_at"]) > known), "own_parent": any_asset(lambda a: F.coalesce(F.array_contains(a["parent_asset_ids"], a["asset_id"]), F.lit(False))),
    }


def across_records(records: DataFrame, key: Column) -> DataFrame:
    """(rule, key, n): what no single row shows: a version given twice, two versions known at the same time, a parent asset
    that no record has."""
    r = records.select(key.alias("key"), "version", instant("available_at").alias("at"), "assets").where("key is not null")
    twice = r.groupBy("key", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_version").alias("rule"), "key", "n")
    together = r.where("at is not null").groupBy("key", "at").agg(F.count_distinct("version").alias("v")).where("v > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("versions_at_one_time").alias("rule"), "key", "n")
    assets = r.select("key", F.explode("assets").alias("a"))
    parents = assets.select("key", F.explode("a.parent_asset_ids").alias("p")).where("p is not null")
    orphans = parents.join(assets.select(F.col("a.asset_id").alias("p")).where("p is not null").distinct(), "p", "left_anti")
    return twice.unionByName(together).unionByName(orphans.groupBy("key").agg(F.count_distinct("p").alias("n")).select(F.lit("unknown_parent").alias("rule"), "key", "n"))


def split_leaks(examples: DataFrame) -> DataFrame:
    """(kind, value, splits): lineages, source groups, sources and dense texts that several splits hold, and families that are
    evaluated but have no training example.

    examples: (family_id, source_group_id, text, split). Nulls leak nothing.
    """
    e = examples.where("split is not null").withColumn("text_sha", F.sha2(T.dense(F.col("text")), 256))
    out = None
    for kind in ("family_id", "source_group_id", "text_sha"):
        one = e.where(f"{kind} is not null").groupBy(F.col(kind).alias("value")).agg(F.count_distinct("split").alias("splits")).where("splits > 1").select(F.lit(kind).alias("kind"), "value", "splits")
        out = one if out is None else out.unionByName(one)
    bare = e.where("family_id is not null").groupBy(F.col("family_id").alias("value")).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_distinct("split").alias("splits")).where("t = 0")
    return out.unionByName(bare.select(F.lit("no_support").alias("kind"), "value", "splits"))


def asset_lineage(records: DataFrame, named) -> DataFrame:
    """(asset_id, parent, state): each derived asset against its parent: parent_missing, parent_later or verified."""
    a = records.select(F.explode("assets").alias("a")).select(named(F.col("a.asset_id")).alias("asset_id"), instant("a.available_at").alias("at"), F.col("a.parent_asset_ids").alias("parents")).where("asset_id is not null")
    first = a.groupBy("asset_id").agg(F.min("at").alias("at"))
    links = a.select("asset_id", F.explode("parents").alias("p")).select("asset_id", named(F.col("p")).alias("parent")).where("parent is not null").distinct()
    j = links.join(first.withColumnRenamed("at", "own"), "asset_id").join(first.select(F.col("asset_id").alias("parent"), F.col("at").alias("theirs"), F.lit(True).alias("there")), "parent", "left")
    return j.select("asset_id", "parent", F.when(F.col("there").isNull(), "parent_missing").when(F.col("theirs") > F.col("own"), "parent_later").otherwise("verified").alias("state"))


def against_manifest(items: DataFrame, manifest: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """(path, state): items against a manifest by path and digest: verified, digest_differs, not_listed or not_there; listed_twice
    where the manifest names a path with several digests."""
    path, digest = keys
    m = manifest.groupBy(F.col(path).alias("path")).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    i = items.groupBy(F.col(path).alias("path")).agg(F.min(digest).alias("own"), F.max(digest).alias("own2"))
    return i.join(m, "path", "full_outer").select(
        "path",
        F.when(F.col("own").isNull(), "not_there").when(F.col("low").isNull(), "not_listed").when(F.col("low") != F.col("high"), "listed_twice")
        .when((F.col("own") == F.col("low")) & (F.col("own2") == F.col("low")), "verified").otherwise("digest_differs").alias("state"),
    )


def admissible_knowledge(notes: DataFrame, at: str) -> DataFrame:
    """notes with `reason`: null for knowledge a machine made by a time; else the first of knowledge_not_automatic,
    human_or_reviewed, available_at_missing_or_invalid, not_available_at_interpretation, knowledge_empty."""
    when = F.lit(at).cast("timestamp")
    kind = F.col("author.type")
    return notes.withColumn("reason", first_reason(
        (kind.isNull() | ~kind.isin(*AUTOMATIC, "human"), "knowledge_not_automatic"), ((kind == "human") | (F.coalesce("human_minutes", F.lit(0.0)) > 0), "human_or_reviewed"),
        (instant("available_at").isNull(), "available_at_missing_or_invalid"), (instant("available_at") > when, "not_available_at_interpretation"), (F.coalesce(F.trim("content"), F.lit("")) == "", "knowledge_empty"),
    ))


def selected_examples(rows: DataFrame, group: str, key: str, at: str, most: int, letters: int, text: str) -> DataFrame:
    """(group, key, reason, excerpt, cut_letters): up to `most` examples per group in the order of their keys, and why the others
    are left out: invalid_example, available_at_missing_or_invalid, not_available_at_interpretation, duplicate, example_cap.

    Texts are excerpts of so many letters, with the letters they lost. A hot group is numbered by parts of equal keys first,
    so that only its first `most` rows of each part meet.
    """
    from pyspark.sql import Window

    when = F.lit(at).cast("timestamp")
    r = rows.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), F.col(text).alias("text"),
        first_reason((F.col(key).isNull(), "invalid_example"), (instant("available_at").isNull(), "available_at_missing_or_invalid"), (instant("available_at") > when, "not_available_at_interpretation")).alias("r1"),
    ).where("grp is not null")
    ok = r.where("r1 is null").groupBy("grp", "key").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("grp", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key")
    near = ok.withColumn("place", F.row_number().over(part))
    first = near.where(F.col("place") <= most).withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("key")))
    ranked = first.unionByName(near.where(F.col("place") > most))
    chosen = ranked.select("grp", "key", F.when(F.col("place") > most, "example_cap").alias("reason"), F.when(F.col("place") <= most, F.substring("text", 1, letters)).alias("excerpt"), F.when((F.col("place") <= most) & (F.length("text") > letters), F.length("text") - letters).alias("cut_letters"))
    again = ok.where("n > 1").select("grp", "key", F.lit("duplicate").alias("reason"), F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("int").alias("cut_letters"))
    out = r.where("r1 is not null").select("grp", "key", F.col("r1").alias("reason"), F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("int").alias("cut_letters"))
    return chosen.unionByName(again).unionByName(out)


def raw_admitted(rows: DataFrame, cutoff: str, forbidden: tuple[str, ...] = ("gold", "gold_label", "gold_interpretation", "annotation", "evaluation_result", "question")) -> DataFrame:
    """(observation_id, reason): observations as bundles take them. A table that has one of the forbidden columns is an error;
    else the first of missing text or id, provenance, and each time that is unusable or after the cutoff."""
    clash = set(forbidden) & set(rows.columns)
    if clash:
        raise ValueError(f"gold or annotation columns: {sorted(clash)}")
    when = F.lit(cutoff).cast("timestamp")
    rules = [(F.col("text").isNull() | F.col("observation_id").isNull(), "text_or_id_missing"), (~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)), "provenance")]
    for name in ("posted_at", "collected_at", "available_at"):
        rules += [(instant(name).isNull(), f"{name}_missing_or_invalid"), (instant(name) > when, f"{name}_after_cutoff")]
    rules += [((F.col("updated_at") != "") & (instant("updated_at").isNull() | (instant("updated_at") > when)), "updated_at_missing_or_after_cutoff")]
    return rows.select("observation_id", first_reason(*rules).alias("reason"))
