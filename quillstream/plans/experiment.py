"""Queries over experiment tables: grids, imports, pairs, ratings, bootstrap, retrieval, running sums, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import experiments as X
from quillstream.plans.dataset import split_of
from quillstream.session import table


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_responses")


def join_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of cases and conditions without a completed response."""
    r = _responses(spark, d)
    return X.grid_difference(X.expected_grid(r, ["C0", "CR", "CF"]), r.where("status = 'completed'"))


def agg_exp_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per model and condition: responses, token-limit hits, mean tokens."""
    r = _responses(spark, d).dropDuplicates(["response_id"])
    return r.groupBy("model_id", "condition").agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(F.col("output_reached_token_limit")).alias("limited"), F.round(F.avg("output_tokens"), 6).alias("mean_tokens"),
    )


def join_pivot_pair(spark: SparkSession, d: str) -> DataFrame:
    """Most tokens of each case under each condition, side by side."""
    r = _responses(spark, d).where("case_id is not null")
    wide = r.groupBy("case_id").pivot("condition", ["C0", "CR", "CF"]).agg(F.max("output_tokens"))
    return wide.select("case_id", F.coalesce("C0", F.lit(-1)).alias("c0"), F.coalesce("CR", F.lit(-1)).alias("cr"), F.coalesce("CF", F.lit(-1)).alias("cf"))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d).dropDuplicates(["response_id"])
    return r.select(F.col("family_id").alias("lineage"), F.col("family_id").alias("family"), F.col("case_id").alias("scenario"), "condition", F.col("output_tokens").cast("double").alias("value"))


def agg_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of tokens between two conditions per family, families counted alike."""
    diff = X.paired_difference(_ratings(spark, d), "C0", "CF")
    return diff.select("family", F.round("difference", 6).alias("difference"))


def agg_pairs_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d).where("case_id is not null").groupBy("case_id").agg(F.count_distinct(F.when(F.col("condition").isin("C0", "CF"), F.col("condition"))).alias("n"))
    return r.groupBy(F.when(F.col("n") == 2, "complete").when(F.col("n") == 1, "partial").otherwise("unrated").alias("state")).agg(F.count(F.lit(1)).alias("cases"))


def win_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Words said twice in a row within titles."""
    cards = table(spark, d, "video_cards").where("title is not null").select("card_id", T.tokens(F.col("title")).alias("w")).where("size(w) > 1")
    pairs = F.filter(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b")), lambda p: p["a"] == p["b"])
    return cards.select("card_id", F.size(pairs).alias("repeats")).where("repeats > 0")


def agg_cost(spark: SparkSession, d: str) -> DataFrame:
    """Exact running total of tokens per model in time order, at each model's last response.

    The running sum is two-level: sums per day are added up before the days' rows are."""
    r = _responses(spark, d).dropDuplicates(["response_id"]).where("created_at is not null")
    day = r.groupBy("model_id", F.to_date("created_at").alias("day")).agg(F.sum(F.col("output_tokens").cast("decimal(38,0)")).alias("tokens"))
    w = Window.partitionBy("model_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("model_id", F.col("day").cast("string").alias("day"), F.sum("tokens").over(w).cast("long").alias("spent"))


def gr_retry_chain(spark: SparkSession, d: str) -> DataFrame:
    """Responses of a request in time order as a chain: each names the one it retries."""
    r = _responses(spark, d).dropDuplicates(["response_id"]).where("request_id is not null")
    w = Window.partitionBy("request_id").orderBy("created_at", "response_id")
    return r.select("request_id", "response_id", F.coalesce(F.lag("response_id").over(w), F.lit("")).alias("retry_of"), F.row_number().over(w).alias("attempt"))


def src_type_profile(spark: SparkSession, d: str) -> DataFrame:
    """Observed type of every property of the events."""
    fields = table(spark, d, "events").select("props").lateralJoin(spark.tvf.variant_explode(F.try_parse_json(F.col("props").outer())))
    return fields.groupBy(F.col("key").alias("name"), F.schema_of_variant("value").alias("type")).agg(F.count(F.lit(1)).alias("n"))


_FIRST = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY request_id) AS dup FROM generation_responses) WHERE dup = 1)"

SQL = {
    "src_type_profile": """WITH k AS (SELECT unnest(json_keys(props)) AS name, props FROM events) SELECT name, CASE json_type(json_extract(props, '$.' || name)) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(json_extract(props, '$.' || name)) END AS type, count(*) AS n FROM k GROUP BY 1, 2""",
    "join_grid": """WITH c AS (SELECT DISTINCT case_id FROM generation_responses), e AS (SELECT case_id, condition FROM c CROSS JOIN (VALUES ('C0'), ('CR'), ('CF')) v(condition)),
      a AS (SELECT DISTINCT case_id, condition FROM generation_responses WHERE status = 'completed')
      SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(e.condition, a.condition) AS condition, CASE WHEN a.case_id IS NULL THEN 'missing' ELSE 'unexpected' END AS state
      FROM e FULL JOIN a ON e.case_id = a.case_id AND e.condition = a.condition WHERE e.case_id IS NULL OR a.case_id IS NULL""",
    "agg_exp_summary": f"WITH {_FIRST} SELECT model_id, condition, count(*) AS responses, count(*) FILTER (WHERE output_reached_token_limit) AS limited, round(avg(output_tokens), 6) AS mean_tokens FROM r GROUP BY model_id, condition",
    "join_pivot_pair": """SELECT case_id, coalesce(max(output_tokens) FILTER (WHERE condition = 'C0'), -1) AS c0, coalesce(max(output_tokens) FILTER (WHERE condition = 'CR'), -1) AS cr,
      coalesce(max(output_tokens) FILTER (WHERE condition = 'CF'), -1) AS cf FROM generation_responses WHERE case_id IS NOT NULL GROUP BY case_id""",
    "agg_ratings": f"""WITH {_FIRST}, m AS (SELECT family_id, case_id, condition, avg(output_tokens) AS v FROM r WHERE condition IN ('C0', 'CF') AND output_tokens IS NOT NULL GROUP BY ALL),
      p AS (SELECT family_id, case_id, max(v) FILTER (WHERE condition = 'C0') AS a, max(v) FILTER (WHERE condition = 'CF') AS b FROM m GROUP BY family_id, case_id)
      SELECT family_id AS family, round(avg(b - a), 6) AS difference FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY family_id""",
    "agg_pairs_coverage": """WITH c AS (SELECT case_id, count(DISTINCT CASE WHEN condition IN ('C0', 'CF') THEN condition END) AS n FROM generation_responses WHERE case_id IS NOT NULL GROUP BY case_id)
      SELECT CASE n WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unrated' END AS state, count(*) AS cases FROM c GROUP BY 1""",
    "win_adjacent": """WITH w AS (SELECT card_id, regexp_extract_all(lower(title), '[가-힣A-Za-z0-9]+') AS w FROM video_cards WHERE title IS NOT NULL),
      c AS (SELECT card_id, len([i for i in range(1, len(w)) if w[i] = w[i + 1]]) AS repeats FROM w WHERE len(w) > 1) SELECT card_id, repeats::INT AS repeats FROM c WHERE repeats > 0""",
    "agg_cost": f"""WITH {_FIRST}, d AS (SELECT model_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, sum(output_tokens) AS t FROM r WHERE created_at IS NOT NULL GROUP BY ALL)
      SELECT model_id, CAST(day AS VARCHAR) AS day, CAST(sum(t) OVER (PARTITION BY model_id ORDER BY day) AS BIGINT) AS spent FROM d""",
    "gr_retry_chain": f"""WITH {_FIRST} SELECT request_id, response_id, coalesce(lag(response_id) OVER w, '') AS retry_of, (row_number() OVER w)::INT AS attempt FROM r WHERE request_id IS NOT NULL
      WINDOW w AS (PARTITION BY request_id ORDER BY created_at, response_id)""",
}


def queries():
    return {f.__name__: f for f in (
        join_grid, agg_exp_summary, join_pivot_pair, agg_ratings, agg_pairs_coverage, win_adjacent, agg_cost,
        gr_retry_chain, src_type_profile,
    )}


def oracle_sql():
    return dict(SQL)
