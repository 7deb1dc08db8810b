"""Experiment tables from requests to blind reports, and the small steps around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators.experiments import expected_grid
from quillstream.operators.selection import set_digest


def extraction_requests(support: DataFrame, allowed: list[str]) -> DataFrame:
    """(family_id, items, request_sha): one request per family over the allowed columns of its support.

    The digest doesn't depend on the order of the rows and needs no list of them, so a family of any size is aggregated.
    """
    row = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in allowed])
    distinct = support.where("family_id is not null").select("family_id", row.alias("row")).distinct()
    return distinct.groupBy("family_id").agg(F.count(F.lit(1)).alias("items"), set_digest(F.col("row")).alias("request_sha"))


def generation_requests(cases: DataFrame, records: DataFrame, conditions: dict[str, bool], repeats: int) -> DataFrame:
    """(case_id, condition, repeat, request_id, state): every case under every condition, several times.

    conditions says which need a record of the case's family; without one the request is a failure, record_missing, and keeps
    its row. cases: (case_id, family_id); records: (family_id). Cases without an id are left out.
    """
    grid = expected_grid(cases.where("case_id is not null"), list(conditions)).join(cases.groupBy("case_id").agg(F.min("family_id").alias("family_id")), "case_id")
    grid = grid.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).join(records.select("family_id").distinct().withColumn("known", F.lit(True)), "family_id", "left")
    needs = F.col("condition").isin(*[c for c, n in conditions.items() if n])
    return grid.select(
        "case_id", "condition", "repeat", T.hash_id("req_", F.col("case_id"), F.col("condition"), F.col("repeat").cast("string")).alias("request_id"),
        F.when(needs & F.col("known").isNull(), "record_missing").otherwise("ready").alias("state"),
    )


def response_state(status: Column, output: Column) -> Column:
    """What became of a planned response: not_there, failed, empty or complete."""
    return F.when(status.isNull(), "not_there").when(status != "completed", "failed").when(F.coalesce(F.regexp_replace(output, r"(?U)\s+", ""), F.lit("")) == "", "empty").otherwise("complete")


def attempts(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """plan (case_id, condition) with every attempt made: attempt (0 where there is none), response_id, state.

    Repeated rows of a response count once; attempts are numbered by time, then id. A cell's attempts are a short list.
    """
    from pyspark.sql import Window

    one = responses.groupBy("response_id").agg(F.min_by(F.struct("case_id", "condition", "status", "output", "created_at"), F.struct("created_at", "request_id")).alias("r")).select("response_id", "r.*")
    numbered = one.where("case_id is not null").withColumn("attempt", F.row_number().over(Window.partitionBy("case_id", "condition").orderBy("created_at", "response_id")))
    j = plan.select("case_id", "condition").distinct().join(numbered, ["case_id", "condition"], "left")
    return j.select("case_id", "condition", F.coalesce("attempt", F.lit(0)).alias("attempt"), "response_id", response_state(F.col("status"), F.col("output")).alias("state"), "output")


def blinded(entries: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """((blind_id, case_id, state, output), (blind_id, condition, attempt, response_id)): what raters see, and the key kept apart."""
    marked = entries.withColumn("blind_id", T.hash_id("b_", F.lit(seed), F.col("case_id"), F.col("condition"), F.col("attempt").cast("string")))
    return marked.select("blind_id", "case_id", "state", "output"), marked.select("blind_id", "condition", "attempt", "response_id")


def staged(entries: DataFrame, first: str, second: str) -> DataFrame:
    """(case_id, a, b, state): each case's first complete output under two conditions side by side, and how far it is:
    complete, a_only, generation_failure (attempts, none complete) or not_started."""
    wide = entries.groupBy("case_id").agg(
        F.min(F.when((F.col("condition") == first) & (F.col("state") == "complete"), F.col("response_id"))).alias("a"),
        F.min(F.when((F.col("condition") == second) & (F.col("state") == "complete"), F.col("response_id"))).alias("b"),
        F.count_if((F.col("attempt") > 0) & F.col("condition").isin(first, second)).alias("tries"),
    )
    state = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "complete").when(F.col("a").isNotNull(), "a_only").when(F.col("tries") > 0, "generation_failure").otherwise("not_started")
    return wide.select("case_id", "a", "b", state.alias("state"))


def material_differences(built: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, state): rows of rebuilt materials against stored ones: missing, unexpected or changed; repeated rows count as often."""
    columns = [c for c in built.columns if c != key]
    digest = lambda df, name: df.groupBy(key).agg(set_digest(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias(name))
    both = digest(built, "x").join(digest(stored.select(*built.columns), "y"), key, "full_outer")
    return both.where("not x <=> y").select(key, F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").otherwise("changed").alias("state"))


def reusable(runs: DataFrame, fingerprint: list[str]) -> DataFrame:
    """(run, of): later runs with the fingerprint of an earlier completed one, and that run. runs: (run, at, status, columns)."""
    mark = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fingerprint]), 256)
    r = runs.select("run", "at", "status", mark.alias("mark")).distinct()
    first = r.where("status = 'completed'").groupBy("mark").agg(F.min(F.struct("at", "run")).alias("first"))
    return r.join(first, "mark").where((F.struct("at", "run") > F.col("first")) & (F.col("run") != F.col("first.run"))).select("run", F.col("first.run").alias("of")).distinct()


def step_breaks(events: DataFrame, key: str, order: list[str], kind: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, kind, before, n): steps of each key's events, in order, that may not follow the step before; `before` is empty for a
    first step. allowed: the steps each step (or '') may lead to."""
    from pyspark.sql import Window

    stepped = events.select(key, kind, F.coalesce(F.lag(kind).over(Window.partitionBy(key).orderBy(*order)), F.lit("")).alias("before"))
    ok = F.lit(False)
    for a, after in allowed.items():
        ok = ok | ((F.col("before") == a) & F.col(kind).isin(*after))
    return stepped.where(~ok).groupBy(key, kind, "before").agg(F.count(F.lit(1)).alias("n"))


def rating_problems(values: DataFrame, value: Column, reason: Column) -> DataFrame:
    """values with `problem`: out_of_range (not 1 to 5), value_and_reason, neither, or null for a rating or an excused gap."""
    given, excused = value.isNotNull(), F.coalesce(F.trim(reason), F.lit("")) != ""
    return values.withColumn("problem", F.when(given & ~value.between(1, 5), "out_of_range").when(given & excused, "value_and_reason").when(~given & ~excused, "neither"))


def several_conditions(assignments: DataFrame, rater: str, family: str, condition: str) -> DataFrame:
    """(rater, family, conditions): raters who would see a family under more than one condition."""
    g = assignments.where(F.col(rater).isNotNull() & F.col(family).isNotNull()).groupBy(rater, family).agg(F.count_distinct(condition).alias("conditions"))
    return g.where("conditions > 1").select(F.col(rater).alias("rater"), F.col(family).alias("family"), "conditions")


def run_status(done: Column, failed: Column) -> Column:
    """completed, partial, failed or empty, from counts of what was done and what failed."""
    return F.when((done > 0) & (failed == 0), "completed").when(done > 0, "partial").when(failed > 0, "failed").otherwise("empty")
