"""Queries over experiment tables and the small steps around them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import experiments as X
from quillstream.operators import review as R
from quillstream.operators import studies as S
from quillstream.plans.core_p import _ts
from quillstream.plans.experiment import _ratings
from quillstream.plans.governance import _DENSE, _WSD
from quillstream.session import table

CONDITIONS = {"C0": False, "CR": True, "CF": True}


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_responses")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    return S.attempts(X.expected_grid(r.where("case_id is not null"), list(CONDITIONS)), r)


def ex_extract_req(spark: SparkSession, d: str) -> DataFrame:
    return S.extraction_requests(table(spark, d, "creation_examples"), ["example_id", "brief", "target"])


def ex_generate(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "meme_records").where("family_id is not null and provenance = 'actual_collected'")
    return S.generation_requests(_responses(spark, d), records, CONDITIONS, 2)


def ex_import(spark: SparkSession, d: str) -> DataFrame:
    """Requests of both repeats against the responses that came."""
    r = _responses(spark, d)
    asked = X.expected_grid(r.where("case_id is not null"), list(CONDITIONS)).select(F.concat_ws("/", "case_id", "condition").alias("request_id"))
    came = r.select(F.concat_ws("/", "case_id", "condition").alias("request_id"), "response_id", "status", "output", "created_at").where("status is not null")
    return X.imported(asked, came)


def ex_export(spark: SparkSession, d: str) -> DataFrame:
    """What raters see, by blind ids."""
    shown, _ = S.blinded(_entries(spark, d), "study-1")
    return shown.select("blind_id", "case_id", "state", F.sha2("output", 256).alias("output_sha"))


def ex_blind_report(spark: SparkSession, d: str) -> DataFrame:
    """The key of the blind ids, with missing attempts kept."""
    return S.blinded(_entries(spark, d), "study-1")[1]


def ex_study_export(spark: SparkSession, d: str) -> DataFrame:
    return S.staged(_entries(spark, d), "C0", "CF")


def ex_render_batch(spark: SparkSession, d: str) -> DataFrame:
    """Planned responses by what became of them."""
    return _entries(spark, d).groupBy("condition", "state").agg(F.count(F.lit(1)).alias("n"))


def ex_bind_study(spark: SparkSession, d: str) -> DataFrame:
    """Complete exported outputs bound to the cases and conditions of the plan."""
    shown, key = S.blinded(_entries(spark, d), "study-1")
    return shown.where("state = 'complete'").join(key, "blind_id").select("case_id", "condition", "attempt", "response_id", "blind_id")


def ex_verify_materials(spark: SparkSession, d: str) -> DataFrame:
    """Responses of one model's requests as rebuilt materials against those of the other, by case."""
    r = _responses(spark, d).where("case_id is not null").select("case_id", "prompt", "model_id").distinct()
    built, stored = (r.where(F.col("model_id") == m).select("case_id", "prompt") for m in ("local-model-a", "local-model-b"))
    return S.material_differences(built, stored, "case_id")


def ex_summarize(spark: SparkSession, d: str) -> DataFrame:
    """Equal-weight mean over families of the difference of two conditions, with its interval from resampled lineages."""
    out = X.cluster_bootstrap(X.paired_difference(_ratings(spark, d), "C0", "CF"), 400, 7)
    return out.select("families", "clusters", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def ex_exp_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per model and condition: responses, copies of the prompt, literal repeats of another response, token-limit hits."""
    r = _responses(spark, d).groupBy("response_id").agg(F.min(F.struct("model_id", "condition", "prompt", "output", "output_reached_token_limit", "case_id")).alias("r")).select("response_id", "r.*")
    r = r.withColumn("o", T.dense(F.col("output"))).withColumn("copied", F.coalesce((F.col("o") != "") & T.dense(F.col("prompt")).contains(F.col("o")), F.lit(False)))
    again = r.where("o <> ''").groupBy("case_id", "o").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", "o", F.lit(True).alias("again"))
    j = r.join(again, ["case_id", "o"], "left")
    return j.groupBy("model_id", "condition").agg(F.count(F.lit(1)).alias("responses"), F.count_if("copied").alias("copies"), F.count_if("again").alias("repeats"), F.count_if("output_reached_token_limit").alias("limited"))


def op_bundle(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").where("text is not null").select(F.col("channel_id").alias("family_id"), "observation_id", "video_id", "channel_id", "text")
    return R.bundles(o)


def op_prompt_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluated example's prompt under its condition: alone, or with the first training example of its family known before."""
    e = table(spark, d, "creation_examples").select("example_id", "family_id", "brief", "split", instant("available_at").alias("at")).where("brief is not null and at is not null")
    pool = e.where("lower(trim(split)) in ('train', 'training')").select("family_id", F.col("example_id").alias("ex"), F.col("brief").alias("eb"), F.col("at").alias("eat"))
    asked = e.where("lower(trim(split)) = 'test'").join(pool, "family_id", "left")
    best = asked.groupBy("example_id").agg(F.min("brief").alias("brief"), F.min(F.when(F.col("eat") < F.col("at"), F.struct("ex", "eb"))).alias("x"))
    prompts = F.array(F.struct(F.lit("C0").alias("condition"), F.col("brief").alias("prompt")), F.struct(F.lit("CR").alias("condition"), F.concat_ws("\n\n", "x.eb", "brief").alias("prompt")))
    return best.select("example_id", F.explode(prompts).alias("p")).select("example_id", "p.condition", F.sha2("p.prompt", 256).alias("prompt_sha"))


def flt_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Models that answer a family under several conditions."""
    return S.several_conditions(_responses(spark, d), "model_id", "family_id", "condition")


def flt_values(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as ratings: 1 to 5, or a reason for a gap."""
    li = table(spark, d, "lineitem")
    value = F.when(F.col("l_quantity") % 9 != 0, F.col("l_linenumber"))
    judged = S.rating_problems(li, value, F.when(F.col("l_quantity") % 18 == 0, F.col("l_returnflag")))
    return judged.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def sx_reuse_identical(spark: SparkSession, d: str) -> DataFrame:
    runs = _responses(spark, d).where("created_at is not null").select(F.col("response_id").alias("run"), F.col("created_at").alias("at"), "status", "model_id", "condition", "case_id")
    return S.reusable(runs, ["model_id", "condition", "case_id"])


def sx_ledger_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of users' events that may not follow the step before."""
    allowed = {"": ["view", "click", "signup"], "view": ["click", "view", "purchase"], "click": ["purchase", "view"], "purchase": ["view"], "signup": ["view"], "error": ["view", "error"]}
    return S.step_breaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", allowed)


def sx_status_ladder(spark: SparkSession, d: str) -> DataFrame:
    """State of each batch of observations, by rows with and without text."""
    b = table(spark, d, "observations").groupBy("batch_id").agg(F.count_if(F.length("text") > 0).alias("done"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("failed"))
    return b.withColumn("state", S.run_status(F.col("done"), F.col("failed")))


def sx_messages(spark: SparkSession, d: str) -> DataFrame:
    """Both arms' payloads of each annotated meme as JSON, by digest."""
    a = table(spark, d, "annotations").where("content is not null and role is not null").select("annotation_id", "role", "content").distinct()
    arm = F.explode(F.array(F.lit("U0"), F.lit("U1"))).alias("arm")
    rows = a.select("annotation_id", "role", "content", arm)
    return rows.select("annotation_id", "arm", F.sha2(F.to_json(F.struct("arm", "role", "content")), 256).alias("payload_sha"))


def sx_slot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Responses found by the digest of a token."""
    slots = _responses(spark, d).where("request_id is not null").select(F.sha2("request_id", 256).alias("token_sha"), "response_id").distinct()
    tokens = _responses(spark, d).where("condition = 'CF' and request_id is not null").select("request_id").distinct().withColumn("token_sha", F.sha2("request_id", 256))
    return tokens.join(slots, "token_sha").select("request_id", "response_id")


def sx_report_text(spark: SparkSession, d: str) -> DataFrame:
    """A line of text per meme about its records."""
    r = table(spark, d, "meme_records").where("meme_id is not null").groupBy("meme_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("version").alias("v"), F.max("provenance").alias("p"))
    origin = F.when(F.col("p") == "actual_collected", "collected").when(F.col("p") == "ai_synthetic", "generated").otherwise("written")
    return r.select("meme_id", F.format_string("%s: %d records, %d versions, %s", "meme_id", "n", "v", origin).alias("line"))


def sx_api_errors(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of error payloads, the known ones only."""
    e = table(spark, d, "events").withColumn("payload", F.concat(F.lit('{"error": {"errors": [{"reason": "'), "event_type", F.lit('"}]}}')))
    reason = F.get_json_object("payload", "$.error.errors[0].reason")
    return e.groupBy(F.when(reason.isin("error", "view"), reason).otherwise("api_error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def agg_progress(spark: SparkSession, d: str) -> DataFrame:
    """Per model: completed and planned cells, and the next one open."""
    r = _responses(spark, d).where("case_id is not null")
    plan = r.select("case_id").distinct().crossJoin(F.broadcast(r.select("model_id").distinct()))  # the models are a handful
    done = r.where("status = 'completed'").select("case_id", "model_id").distinct().withColumn("done", F.lit(True))
    j = plan.join(done, ["case_id", "model_id"], "left")
    return j.groupBy("model_id").agg(F.count("done").alias("completed"), F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("done").isNull(), F.col("case_id"))).alias("next"))


def agg_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 50 that each query's cards take."""
    q = table(spark, d, "video_cards").where("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("cards"))
    return q.withColumn("pages", F.ceil(F.col("cards") / 50).cast("long"))


def rg_query(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a registry of responses: per fingerprint the first, the last, how many, and the state of the last."""
    r = _responses(spark, d).where("created_at is not null").groupBy("response_id").agg(F.min(F.struct("created_at", "request_id", "status", "model_id", "condition")).alias("r")).select("response_id", "r.*")
    mark = F.substring(F.sha2(F.concat_ws("|", "request_id", "model_id", "condition"), 256), 1, 20)
    last = F.struct("created_at", "response_id")
    return r.groupBy(mark.alias("fingerprint")).agg(F.min_by("response_id", last).alias("first"), F.max_by("response_id", last).alias("last"), F.count(F.lit(1)).alias("runs"), F.max_by("status", last).alias("state"))


_ONE = "o AS (SELECT response_id, r.* FROM (SELECT response_id, arg_min({'case_id': case_id, 'condition': condition, 'status': status, 'output': output, 'created_at': created_at}, (created_at, request_id)) AS r FROM generation_responses GROUP BY response_id))"
_ENTRIES = _ONE + """, p AS (SELECT DISTINCT case_id, v.condition FROM generation_responses, (VALUES ('C0'), ('CR'), ('CF')) v(condition) WHERE case_id IS NOT NULL),
      nn AS (SELECT *, row_number() OVER (PARTITION BY case_id, condition ORDER BY created_at, response_id) AS attempt FROM o WHERE case_id IS NOT NULL),
      en AS (SELECT p.case_id, p.condition, coalesce(attempt, 0)::INT AS attempt, response_id, output, CASE WHEN status IS NULL THEN 'not_there' WHEN status <> 'completed' THEN 'failed' WHEN coalesce(regexp_replace(output, '@WS@', '', 'g'), '') = '' THEN 'empty' ELSE 'complete' END AS state
        FROM p LEFT JOIN nn ON p.case_id = nn.case_id AND p.condition = nn.condition),
      bl AS (SELECT *, 'b_' || substr(sha256(concat_ws(chr(31), 'study-1', case_id, condition, CAST(attempt AS VARCHAR))), 1, 20) AS blind_id FROM en)""".replace("@WS@", _WSD)


def _digest(item: str) -> str:
    h = f"sha256({item})"
    return "sha256(concat_ws('|', " + ", ".join(f"CAST(sum(('0x' || substr({h}, {i}, 15))::BIGINT::HUGEINT) AS VARCHAR)" for i in (1, 16, 31, 46)) + "))"


SQL = {
    "ex_extract_req": f"""WITH r AS (SELECT DISTINCT family_id, coalesce(example_id, '') || chr(31) || coalesce(brief, '') || chr(31) || coalesce(target, '') AS row FROM creation_examples WHERE family_id IS NOT NULL)
      SELECT family_id, count(*) AS items, {_digest('row')} AS request_sha FROM r GROUP BY family_id""",
    "ex_generate": """WITH c AS (SELECT case_id, min(family_id) AS f FROM generation_responses WHERE case_id IS NOT NULL GROUP BY case_id), k AS (SELECT DISTINCT family_id FROM meme_records WHERE family_id IS NOT NULL AND provenance = 'actual_collected')
      SELECT case_id, condition, repeat, 'req_' || substr(sha256(concat_ws(chr(31), case_id, condition, CAST(repeat AS VARCHAR))), 1, 20) AS request_id, CASE WHEN condition IN ('CR', 'CF') AND f NOT IN (SELECT family_id FROM k) THEN 'record_missing' ELSE 'ready' END AS state
      FROM c, (VALUES ('C0'), ('CR'), ('CF')) v(condition), (VALUES (1), (2)) w(repeat)""",
    "ex_import": """WITH a AS (SELECT DISTINCT case_id || '/' || v.condition AS request_id FROM generation_responses, (VALUES ('C0'), ('CR'), ('CF')) v(condition) WHERE case_id IS NOT NULL),
      f AS (SELECT case_id || '/' || condition AS request_id, status, output, row_number() OVER (PARTITION BY case_id, condition ORDER BY created_at, response_id) AS n FROM generation_responses WHERE status IS NOT NULL)
      SELECT a.request_id, CASE WHEN f.request_id IS NULL THEN 'response_missing' WHEN status <> 'completed' THEN 'provider_error' WHEN output IS NULL OR trim(output, ' ') = '' THEN 'invalid_record' ELSE 'imported' END AS state FROM a LEFT JOIN f ON f.request_id = a.request_id AND n = 1""",
    "ex_export": f"WITH {_ENTRIES} SELECT blind_id, case_id, state, sha256(output) AS output_sha FROM bl",
    "ex_blind_report": f"WITH {_ENTRIES} SELECT blind_id, condition, attempt, response_id FROM bl",
    "ex_bind_study": f"WITH {_ENTRIES} SELECT case_id, condition, attempt, response_id, blind_id FROM bl WHERE state = 'complete'",
    "ex_render_batch": f"WITH {_ENTRIES} SELECT condition, state, count(*) AS n FROM en GROUP BY ALL",
    "ex_study_export": f"""WITH {_ENTRIES}, w AS (SELECT case_id, min(response_id) FILTER (WHERE condition = 'C0' AND state = 'complete') AS a, min(response_id) FILTER (WHERE condition = 'CF' AND state = 'complete') AS b, count(*) FILTER (WHERE attempt > 0 AND condition IN ('C0', 'CF')) AS t FROM en GROUP BY case_id)
      SELECT case_id, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'complete' WHEN a IS NOT NULL THEN 'a_only' WHEN t > 0 THEN 'generation_failure' ELSE 'not_started' END AS state FROM w""",
    "ex_verify_materials": """WITH r AS (SELECT DISTINCT case_id, coalesce(prompt, '') AS p, model_id FROM generation_responses WHERE case_id IS NOT NULL), x AS (SELECT case_id, string_agg(p, chr(31) ORDER BY p) AS p FROM r WHERE model_id = 'local-model-a' GROUP BY case_id), y AS (SELECT case_id, string_agg(p, chr(31) ORDER BY p) AS p FROM r WHERE model_id = 'local-model-b' GROUP BY case_id)
      SELECT coalesce(x.case_id, y.case_id) AS case_id, CASE WHEN y.case_id IS NULL THEN 'missing' WHEN x.case_id IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM x FULL JOIN y ON x.case_id = y.case_id WHERE x.p IS DISTINCT FROM y.p""",
    "ex_summarize": """WITH r AS (SELECT DISTINCT ON (response_id) * FROM generation_responses), m AS (SELECT family_id, case_id, condition, avg(output_tokens) AS v FROM r WHERE condition IN ('C0', 'CF') AND output_tokens IS NOT NULL GROUP BY ALL),
      p AS (SELECT family_id, case_id, max(v) FILTER (WHERE condition = 'C0') AS a, max(v) FILTER (WHERE condition = 'CF') AS b FROM m GROUP BY family_id, case_id), f AS (SELECT family_id, avg(b - a) AS diff FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY family_id),
      c AS (SELECT family_id, diff, row_number() OVER (ORDER BY family_id) AS place FROM f WHERE family_id IS NOT NULL), n AS (SELECT count(*) AS m FROM c),
      t AS (SELECT draw, (('0x' || substr(sha256('7|' || draw || '|' || i), 1, 13))::BIGINT % m) + 1 AS place FROM n, range(400) x(draw), (SELECT unnest(range(1, m + 1)) AS i FROM n)),
      d AS (SELECT draw, avg(diff) AS v FROM t JOIN c USING (place) GROUP BY draw), s AS (SELECT list_sort(list(v)) AS v FROM d)
      SELECT (SELECT count(*) FROM f) AS families, (SELECT m FROM n) AS clusters, round((SELECT avg(diff) FROM f), 6) AS mean, round(v[CAST(floor(0.025 * 399) AS BIGINT) + 1], 6) AS low, round(v[CAST(floor(0.975 * 399) AS BIGINT) + 1], 6) AS high FROM s""",
    "ex_exp_summary": f"""WITH r AS (SELECT response_id, x.* FROM (SELECT response_id, min({{'model_id': model_id, 'condition': condition, 'prompt': prompt, 'output': output, 'lim': output_reached_token_limit, 'case_id': case_id}}) AS x FROM generation_responses GROUP BY response_id)),
      q AS (SELECT *, {_DENSE.format('output')} AS o, {_DENSE.format('prompt')} AS p FROM r), g AS (SELECT case_id, o FROM q WHERE o <> '' AND case_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
      SELECT model_id, condition, count(*) AS responses, count(*) FILTER (WHERE q.o <> '' AND contains(p, q.o)) AS copies, count(g.o) AS repeats, count(*) FILTER (WHERE lim) AS limited FROM q LEFT JOIN g ON g.case_id = q.case_id AND g.o = q.o GROUP BY model_id, condition""",
    "op_bundle": f"""WITH o AS (SELECT channel_id AS family_id, count(*) AS rows, count(DISTINCT video_id) AS videos, count(DISTINCT channel_id) AS channels, count(DISTINCT text) AS texts, {_digest('concat_ws(chr(31), observation_id, text)')} AS raw_sha256 FROM observations WHERE text IS NOT NULL AND channel_id IS NOT NULL GROUP BY channel_id)
      SELECT o.*, arm FROM o CROSS JOIN (VALUES ('U0'), ('U1')) v(arm)""",
    "op_prompt_cases": f"""WITH e AS (SELECT example_id, family_id, brief, lower(trim(split)) AS s, {_ts('available_at')} AS t FROM creation_examples WHERE brief IS NOT NULL AND {_ts('available_at')} IS NOT NULL),
      b AS (SELECT a.example_id, min(a.brief) AS brief, min(CASE WHEN p.t < a.t THEN {{'ex': p.example_id, 'eb': p.brief}} END) AS x FROM e a LEFT JOIN e p ON p.family_id = a.family_id AND p.s IN ('train', 'training') WHERE a.s = 'test' GROUP BY a.example_id)
      SELECT example_id, 'C0' AS condition, sha256(brief) AS prompt_sha FROM b UNION ALL SELECT example_id, 'CR', sha256(concat_ws(chr(10) || chr(10), x.eb, brief)) FROM b""",
    "flt_bundle": "SELECT model_id AS rater, family_id AS family, count(DISTINCT condition) AS conditions FROM generation_responses WHERE model_id IS NOT NULL AND family_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT condition) > 1",
    "flt_values": """SELECT CASE WHEN l_quantity % 9 <> 0 AND NOT l_linenumber BETWEEN 1 AND 5 THEN 'out_of_range' WHEN l_quantity % 9 = 0 AND NOT (l_quantity % 18 = 0 AND trim(l_returnflag) <> '') THEN 'neither' ELSE 'ok' END AS problem, count(*) AS n FROM lineitem GROUP BY 1""",
    "sx_reuse_identical": """WITH r AS (SELECT DISTINCT response_id AS run, created_at AS t, status, coalesce(model_id, '') || chr(31) || coalesce(condition, '') || chr(31) || coalesce(case_id, '') AS k FROM generation_responses WHERE created_at IS NOT NULL), f AS (SELECT k, min((t, run)) AS x FROM r WHERE status = 'completed' GROUP BY k),
      g AS (SELECT k, arg_min(run, (t, run)) AS first FROM r WHERE status = 'completed' GROUP BY k) SELECT DISTINCT r.run, g.first AS of FROM r JOIN f USING (k) JOIN g USING (k) WHERE (r.t, r.run) > f.x AND r.run <> g.first""",
    "sx_ledger_steps": """WITH s AS (SELECT user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM events)
      SELECT user_id, event_type, before, count(*) AS n FROM s WHERE NOT coalesce((before, event_type) IN (('', 'view'), ('', 'click'), ('', 'signup'), ('view', 'click'), ('view', 'view'), ('view', 'purchase'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view'), ('signup', 'view'), ('error', 'view'), ('error', 'error')), false) GROUP BY ALL""",
    "sx_status_ladder": """WITH b AS (SELECT batch_id, count(*) FILTER (WHERE length(text) > 0) AS done, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS failed FROM observations GROUP BY batch_id)
      SELECT *, CASE WHEN done > 0 AND failed = 0 THEN 'completed' WHEN done > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'empty' END AS state FROM b""",
    "sx_messages": """WITH a AS (SELECT DISTINCT annotation_id, role, content FROM annotations WHERE content IS NOT NULL AND role IS NOT NULL)
      SELECT annotation_id, arm, sha256(CAST(json_object('arm', arm, 'role', role, 'content', content) AS VARCHAR)) AS payload_sha FROM a CROSS JOIN (VALUES ('U0'), ('U1')) v(arm)""",
    "sx_slot_lookup": "SELECT DISTINCT t.request_id, s.response_id FROM generation_responses t JOIN generation_responses s USING (request_id) WHERE t.condition = 'CF' AND t.request_id IS NOT NULL",
    "sx_report_text": """SELECT meme_id, printf('%s: %d records, %d versions, %s', meme_id, count(*), count(DISTINCT version), CASE max(provenance) WHEN 'actual_collected' THEN 'collected' WHEN 'ai_synthetic' THEN 'generated' ELSE 'written' END) AS line FROM meme_records WHERE meme_id IS NOT NULL GROUP BY meme_id""",
    "sx_api_errors": "SELECT CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'api_error' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "agg_progress": """WITH c AS (SELECT DISTINCT case_id FROM generation_responses WHERE case_id IS NOT NULL), m AS (SELECT DISTINCT model_id FROM generation_responses WHERE case_id IS NOT NULL), d AS (SELECT DISTINCT case_id, model_id, true AS done FROM generation_responses WHERE case_id IS NOT NULL AND status = 'completed')
      SELECT m.model_id, count(done) AS completed, count(*) AS total, min(CASE WHEN done IS NULL THEN c.case_id END) AS next FROM c CROSS JOIN m LEFT JOIN d ON d.case_id = c.case_id AND d.model_id = m.model_id GROUP BY m.model_id""",
    "agg_plan": "SELECT query, count(*) AS cards, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM video_cards WHERE query IS NOT NULL GROUP BY query",
    "rg_query": """WITH r AS (SELECT response_id, x.* FROM (SELECT response_id, min({'t': created_at, 'request_id': request_id, 'status': status, 'model_id': model_id, 'condition': condition}) AS x FROM generation_responses WHERE created_at IS NOT NULL GROUP BY response_id))
      SELECT substr(sha256(concat_ws('|', request_id, model_id, condition)), 1, 20) AS fingerprint, arg_min(response_id, (t, response_id)) AS first, arg_max(response_id, (t, response_id)) AS last, count(*) AS runs, arg_max(status, (t, response_id)) AS state FROM r GROUP BY 1""",
}


def queries():
    return {f.__name__: f for f in (
        ex_extract_req, ex_generate, ex_import, ex_export, ex_blind_report, ex_study_export, ex_render_batch, ex_bind_study, ex_verify_materials, ex_summarize, ex_exp_summary, op_bundle, op_prompt_cases,
        flt_bundle, flt_values, sx_reuse_identical, sx_ledger_steps, sx_status_ladder, sx_messages, sx_slot_lookup, sx_report_text, sx_api_errors, agg_progress, agg_plan, rg_query,
    )}


def oracle_sql():
    return dict(SQL)
