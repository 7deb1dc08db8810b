"""Experiment tables: grids, imports, ratings, bootstrap, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators.selection import ranked
from quillstream.session import keep


def expected_grid(cases: DataFrame, conditions: list[str]) -> DataFrame:
    """(case_id, condition): every case under every condition; the conditions are a short fixed list."""
    return cases.select("case_id").distinct().withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))


def grid_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, condition, state): cells missing from, or unexpected in, the actual ones."""
    keys = ["case_id", "condition"]
    e = expected.select(*keys).distinct().withColumn("e", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("a", F.lit(True))
    both = e.join(a, keys, "full_outer")
    return both.where("e is null or a is null").select(*keys, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("state"))


def imported(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, state): provider_error, invalid_record, response_missing or imported, by the request's first response."""
    first = responses.groupBy("request_id").agg(F.min_by(F.struct("status", "output"), F.struct("created_at", "response_id")).alias("r"))
    joined = requests.select("request_id").distinct().join(first, "request_id", "left")
    return joined.select(
        "request_id",
        F.when(F.col("r").isNull(), "response_missing").when(F.col("r.status") != "completed", "provider_error")
        .when(F.col("r.output").isNull() | (F.trim("r.output") == ""), "invalid_record").otherwise("imported").alias("state"),
    )


def paired_difference(ratings: DataFrame, base: str, other: str) -> DataFrame:
    """(lineage, family, difference): mean over raters, then the pair's difference per scenario, then the mean per family.

    ratings: (lineage, family, scenario, condition, value). Scenarios rated under one condition only make no pair.
    """
    means = ratings.where(F.col("condition").isin(base, other) & F.col("value").isNotNull()).groupBy("lineage", "family", "scenario", "condition").agg(F.avg("value").alias("v"))
    pairs = means.groupBy("lineage", "family", "scenario").pivot("condition", [base, other]).agg(F.first("v"))
    diff = pairs.where(F.col(f"`{base}`").isNotNull() & F.col(f"`{other}`").isNotNull())
    return diff.groupBy("lineage", "family").agg(F.avg(F.col(f"`{other}`") - F.col(f"`{base}`")).alias("difference"))


def cluster_bootstrap(families: DataFrame, draws: int, seed: int) -> DataFrame:
    """(families, clusters, mean, low, high): equal-weight mean over families and its interval from resampled lineages.

    Every draw takes as many lineages as there are, with replacement: the i-th by a seeded hash of (seed, draw, i), from the
    numbered lineages, and averages over the families of the lineages taken. The interval is made of the order statistics
    at 2.5 and 97.5 %, not interpolated, and needs two lineages at least.
    """
    per = families.where("lineage is not null").groupBy("lineage").agg(F.sum("difference").alias("s"), F.count(F.lit(1)).alias("n"))
    clusters = keep(ranked(per, [F.col("lineage")], "place"))
    m = clusters.count()
    point = families.agg(F.count(F.lit(1)).alias("families"), F.count_distinct("lineage").alias("clusters"), F.avg("difference").alias("mean"))
    if m < 2:
        return point.select("families", "clusters", "mean", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string")), 256), 1, 13), 16, 10).cast("long")
    spark = families.sparkSession
    taken = spark.range(draws).withColumnRenamed("id", "draw").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(m).cast("long")))).select("draw", (pick % m + 1).alias("place"))
    means = taken.groupBy("draw", "place").agg(F.count(F.lit(1)).alias("w")).join(clusters, "place").groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # `draws` numbers
    at = lambda q: F.element_at("m", F.lit(int(q * (draws - 1)) + 1))
    return point.crossJoin(ordered).select("families", "clusters", "mean", at(0.025).alias("low"), at(0.975).alias("high"))  # one row each


def tfidf_retrieve(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, example_id, score, rank): the k nearest of the query's own group by character 2- and 3-gram TF-IDF cosine.

    queries: (query_id, grp, text); pool: (example_id, grp, text). Weights are (1 + ln c)(ln((1 + N) / (1 + df)) + 1) within a
    group's pool; a query term no example has counts in the query's norm only. Ties go to the smaller id. Null groups and
    texts take no part.
    """

    def bag(df: DataFrame, id_col: str) -> DataFrame:
        grams = F.concat(T.char_ngrams(F.col("text"), 2), T.char_ngrams(F.col("text"), 3))
        return df.where("grp is not null and text is not null").select(id_col, "grp", F.explode(grams).alias("term")).groupBy(id_col, "grp", "term").agg(F.count(F.lit(1)).alias("c"))

    docs = keep(bag(pool, "example_id"))
    size = pool.where("grp is not null and text is not null").groupBy("grp").agg(F.count_distinct("example_id").alias("n_docs"))
    df = docs.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(size, "grp").select("grp", "term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weight = (F.log("c") + 1) * F.col("idf")
    d = docs.join(idf, ["grp", "term"]).select("example_id", "grp", "term", weight.alias("wd"))
    d_norm = d.groupBy("example_id", "grp").agg(F.sqrt(F.sum(F.col("wd") ** 2)).alias("nd"))
    q = bag(queries, "query_id").join(idf, ["grp", "term"], "left").join(size, "grp").select(
        "query_id", "grp", "term", ((F.log("c") + 1) * F.coalesce("idf", F.log(F.col("n_docs") + 1) + 1)).alias("wq")
    )
    q_norm = q.groupBy("query_id", "grp").agg(F.sqrt(F.sum(F.col("wq") ** 2)).alias("nq"))
    dots = q.join(d, ["grp", "term"]).groupBy("query_id", "example_id", "grp").agg(F.sum(F.col("wq") * F.col("wd")).alias("dot"))
    scored = dots.join(q_norm, ["query_id", "grp"]).join(d_norm, ["example_id", "grp"]).select(
        "query_id", "example_id", F.when(F.col("nq") * F.col("nd") > 0, F.col("dot") / (F.col("nq") * F.col("nd"))).otherwise(0.0).alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "example_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
