"""Queries on results: recipes, latencies, coverage and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import measures
from quern.plans.common import ANSWERED, NUMBER, SEED, answered, first_sentence, sql_normal
from quern.runtime import Stash, table

RECIPES = (("base", False), ("rag", True), ("sft-rag", True), ("raft-rag", True))
SAMPLES = 1001
METRICS = ("exact_match", "token_f1")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions: the type is the recipe, the value a latency, the property k a number of tokens."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("recipe"),
        value.alias("generate_s"),
        F.when(F.col("event_id") % 3 != 0, F.abs("value") * 0.1).alias("retrieval_s"),
        k.alias("answer_tokens"),
        (k + 5).alias("prompt_tokens"),
        F.when(F.col("event_id") % 10 == 0, F.lit("error")).when(F.col("event_id") % 4 != 0, F.lit("ok")).alias("judge_status"),
        F.when(F.col("event_id") % 4 != 0, F.abs("value") / (1 + F.abs("value"))).alias("judge_correctness"),
        (F.col("event_id") % 7 == 0).alias("hit"),
    )


def recipe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.recipe_summary(_events(spark, sf_dir), ["generate_s", "judge_correctness"])


def stage_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.stage_latencies(_events(spark, sf_dir), ["generate_s", "retrieval_s"])


def latency_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    whole = measures.latency(F.when(F.col("answer_tokens") % 2 == 0, F.col("generate_s")), [F.col("generate_s"), F.col("retrieval_s")], F.lit(0.5))
    return rows.select("id", F.round(whole, 6).alias("seconds"))


def throughput_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    both = F.col("answer_tokens") + F.col("prompt_tokens")
    return rows.groupBy("recipe").agg(
        F.round(measures.rate(F.col("answer_tokens"), F.col("generate_s")), 6).alias("output_rate"),
        F.round(measures.rate(both, F.col("generate_s")), 6).alias("total_rate"),
    )


def judge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.judge_coverage(_events(spark, sf_dir), "recipe", "judge_status", "hit")


def metric_means_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.metric_means(_events(spark, sf_dir), "recipe", ["generate_s", "retrieval_s", "judge_correctness"])


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recipe, id, prediction, retrieved, exact_match, token_f1): the recipes over all examples with documents, answered by a stand-in.

    The stand-in answers with the first sentence of the document that the recipe's number names, or "unknown" without
    one; documents are those that the example lists. All recipes record them, base uses none.
    """
    base = answered(spark, sf_dir).select("id", "reference_answer", "ids", "texts")
    recipes = F.explode(F.array(*(F.struct(F.lit(r).alias("recipe"), F.lit(use).alias("use"), F.lit(n).alias("nth")) for n, (r, use) in enumerate(RECIPES))))
    rows = base.select("*", recipes.alias("r")).select("id", "reference_answer", "ids", "texts", "r.*")
    answer = F.when(F.col("use") & (F.size("texts") >= F.col("nth")), first_sentence(F.get("texts", F.col("nth") - 1))).otherwise("unknown")
    rows = rows.withColumn("prediction", answer)
    refs = text.references(F.lit(None).cast("array<string>"), F.col("reference_answer"))
    return rows.select(
        "recipe",
        "id",
        "prediction",
        F.array_join("ids", " ").alias("retrieved"),
        text.best_over(refs, lambda r: text.exact_match(F.col("prediction"), r)).alias("exact_match"),
        F.round(text.best_over(refs, lambda r: text.token_f1(F.col("prediction"), r)), 6).alias("token_f1"),
    )


def recipe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stash(spark).put(measures.paired(_predictions(spark, sf_dir), METRICS))


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.paired_summary(_deltas(spark, sf_dir))


def bootstrap_ci_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.bootstrap_hashed(_deltas(spark, sf_dir), SAMPLES, SEED)


def bootstrap_ci_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.bootstrap_numpy(_deltas(spark, sf_dir), 10_000, SEED)


def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = _deltas(spark, sf_dir)
    rows = measures.decisions(measures.paired_summary(deltas), measures.bootstrap_hashed(deltas, SAMPLES, SEED), controls_matched=False)
    return rows.select("pair", "metric", "pairs", "delta", "ci95_low", "ci95_high", "status", "eligible", "significant")


def unpaired_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of recipes that didn't see the same examples, were the last recipe to lose every third one."""
    rows = _predictions(spark, sf_dir).where((F.col("recipe") != "raft-rag") | (F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 3 != 0))
    return measures.unpaired_ids(rows.select("recipe", "id"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured prediction rows: latencies of some stages, tokens, and scores that only some rows have."""
    rows = _events(spark, sf_dir)
    number = F.col("id").cast("bigint")
    return rows.withColumns({
        "model_generate_latency_s": F.col("generate_s"),
        "retrieval_latency_s": F.col("retrieval_s"),
        "retrieval_used": number % 2 == 0,
        "output_tokens": F.col("answer_tokens"),
        "exact_match": (number % 4 == 0).cast("double"),
        "token_f1": F.col("judge_correctness"),
        "batch_size": (number % 8).cast("int"),
        "generation_mode": F.when(number % 2 == 0, "sampled").otherwise("greedy"),
        "scores": F.map_concat(F.create_map(F.lit("grounded"), F.abs("generate_s") / 10, F.lit("judge_attempts"), F.lit(1.0)), F.when(number % 3 == 0, F.create_map(F.lit("cited"), F.lit(0.5) + F.col("answer_tokens") / 100)).otherwise(F.create_map(F.lit("cited"), F.lit(None).cast("double")))),
    })


def recipe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measures.recipe_metrics(_measured(spark, sf_dir))
    kept = [c for c in rows.columns if not any(c.startswith(s.removesuffix("_s")) for s in measures.STAGES if s not in ("retrieval_latency_s", "model_generate_latency_s"))]
    return rows.select(*(c for c in kept if not c.startswith("end_to_end")))


def score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.score_means(_measured(spark, sf_dir))


def judge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = F.col("judge_correctness")
    rows = _events(spark, sf_dir).withColumns({"judge_groundedness": F.when(F.col("judge_status") == "ok", judged), "judge_unsupported_claim_rate": F.lit(None).cast("double"), "judge_cache_hit": F.col("hit")})
    return measures.judge_blocks(rows, minimum=0.7)


def row_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second of each row, null without a positive latency."""
    rows = _events(spark, sf_dir)
    return rows.select("id", F.round(measures.row_rate(F.col("answer_tokens"), F.col("generate_s")), 6).alias("output_rate"), F.round(measures.row_rate(F.col("answer_tokens") + F.col("prompt_tokens"), F.col("generate_s")), 6).alias("total_rate"))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paired evaluation with stand-ins: base repeats the first sentence of a document, tuned all of it up to the second one's end.

    Under rag the document is the last that the example lists, under oracle the first.
    """
    rows = answered(spark, sf_dir).where("reference_answer is not null and reference_answer <> ''").select("id", "reference_answer", "texts", "refs", "ids")
    kinds = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition")) for m in ("base", "tuned") for c in ("rag", "oracle"))))
    rows = rows.select("*", kinds.alias("k")).select("*", "k.*")
    document = F.when(F.col("condition") == "rag", F.element_at("texts", -1)).otherwise(F.get("texts", F.lit(0)))
    said = F.when(F.col("model") == "base", first_sentence(document)).otherwise(F.regexp_extract(document, r"^[^.!?]*[.!?]?[^.!?]*", 0))
    refs = text.references(F.lit(None).cast("array<string>"), F.col("reference_answer"))
    rows = rows.withColumns({"prediction": said, "references": refs})
    n = F.char_length("prediction").cast("bigint")
    return rows.select(
        "id", "model", "condition", "prediction",
        text.best_over(F.col("references"), lambda r: text.exact_match(F.col("prediction"), r)).alias("exact_match"),
        text.best_over(F.col("references"), lambda r: text.token_f1(F.col("prediction"), r)).alias("token_f1"),
        text.contains_answer(F.col("prediction"), F.col("references")).alias("answer_containment"),
        (n / 1000).alias("model_generate_latency_s"), n.alias("output_tokens"), F.lit(0).alias("reasoning_tokens"), n.alias("answer_tokens"),
    )


def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.condition_summary(_conditions(spark, sf_dir))


def condition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.condition_deltas(measures.condition_summary(_conditions(spark, sf_dir)))


def condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.paired_summary(measures.condition_pairs(_conditions(spark, sf_dir)))


def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids cut at the boundary 99; built from the events: padding is 1, which is also the end."""
    from quern.functions.thinking import split_thinking

    k = F.get_json_object("props", "$.k").cast("int")
    body = F.transform(F.sequence(F.lit(1), k % 4 + 2), lambda i: i + 10)
    ids = F.concat(body, F.when(F.col("event_id") % 5 != 0, F.array(F.lit(99))).otherwise(F.array().cast("array<int>")), F.array(F.lit(20), F.lit(1), F.lit(1)))
    return table(spark, sf_dir, "events").select("event_id", split_thinking(ids, pad=1, eos=1, opening=98, closing=99).alias("t")).select(
        "event_id",
        F.size("t.reasoning").cast("bigint").alias("n_reasoning"),
        F.size("t.answer").cast("bigint").alias("n_answer"),
        F.size("t.output").cast("bigint").alias("n_output"),
        F.col("t.problem").alias("problem"),
    )


_EVENTS = """e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, event_type AS recipe, value AS generate_s, CASE WHEN event_id % 3 <> 0 THEN abs(value) * 0.1 END AS retrieval_s,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS answer_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) + 5 AS prompt_tokens,
  CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 4 <> 0 THEN 'ok' END AS judge_status, CASE WHEN event_id % 4 <> 0 THEN abs(value) / (1 + abs(value)) END AS judge_correctness, event_id % 7 = 0 AS hit FROM events)"""
_STAGE = "SELECT recipe, '{0}' AS stage, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95 FROM e GROUP BY recipe"
_MEAN = "SELECT recipe, '{0}' AS metric, count({0}) AS numeric, round(avg({0}), 6) AS mean FROM e WHERE {0} IS NOT NULL GROUP BY recipe"


def _f1(p: str, r: str) -> str:
    shared = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({r}, lambda y: y = x))))), 0)"
    return f"CASE WHEN len({p}) = 0 OR len({r}) = 0 THEN CASE WHEN len({p}) = len({r}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 2.0::DOUBLE * {shared} / (len({p}) + len({r})) END"


def _list(column: str) -> str:
    return f"list_filter(string_split({sql_normal(column)}, ' '), lambda z: z <> '')"


_PREDICTIONS = f"""{ANSWERED},
p0 AS (SELECT an.id, an.reference_answer AS ref, array_to_string(an.ids, ' ') AS retrieved, n.recipe, CASE WHEN n.nth > 0 AND len(an.texts) >= n.nth THEN regexp_extract(an.texts[n.nth], '^[^.!?]*[.!?]?') ELSE 'unknown' END AS prediction
       FROM an, (VALUES ('base', 0), ('rag', 1), ('sft-rag', 2), ('raft-rag', 3)) n(recipe, nth)),
p1 AS (SELECT *, {_list('prediction')} AS a, {_list('ref')} AS b FROM p0),
p AS (SELECT recipe, id, prediction, retrieved, CASE WHEN coalesce(ref, '') <> '' THEN CASE WHEN {sql_normal('prediction')} = {sql_normal('ref')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS exact_match,
      CASE WHEN coalesce(ref, '') <> '' THEN round({_f1('a', 'b')}, 6) END AS token_f1 FROM p1)"""
_DELTAS = f"""{_PREDICTIONS},
l AS (SELECT recipe, id, 'exact_match' AS metric, exact_match AS v FROM p UNION ALL SELECT recipe, id, 'token_f1', token_f1 FROM p),
d0 AS (SELECT x.base || '->' || x.cand AS pair, b.metric, b.id, b.v AS baseline, q.v AS candidate, q.v - b.v AS delta
       FROM (VALUES ('base', 'rag'), ('rag', 'sft-rag'), ('rag', 'raft-rag'), ('sft-rag', 'raft-rag')) x(base, cand) JOIN l b ON b.recipe = x.base JOIN l q ON q.recipe = x.cand AND q.id = b.id AND q.metric = b.metric)"""
_SUMMARY = "SELECT pair, metric, count(*) AS total, count(baseline) AS baseline_numeric, count(candidate) AS candidate_numeric, count(delta) AS pairs, round(count(delta) / count(*), 6) AS coverage, round(avg(delta), 6) AS delta, count(delta) >= 1 AS eligible FROM d0 GROUP BY pair, metric"
_STEPS = ", ".join(map(str, measures.poisson_steps()))
_BOOT = f"""{_DELTAS},
h AS (SELECT id, j, sha256(concat_ws(':', '42', id, j)) AS x FROM (SELECT DISTINCT id FROM d0 WHERE delta IS NOT NULL), range(0, {-(-SAMPLES // measures.PER_HASH)}) t(j)),
w AS (SELECT id, j * {measures.PER_HASH} + k + 1 AS i, CAST('0x' || substr(x, 1 + 12 * k, 12) AS BIGINT) AS u FROM h, range(0, {measures.PER_HASH}) r(k)),
z AS (SELECT id, i, len(list_filter([{_STEPS}], lambda s: s <= u)) AS n FROM w WHERE i <= {SAMPLES}),
m AS (SELECT d.pair, d.metric, z.i, CAST(sum(z.n * CAST(round(d.delta * 1e9) AS BIGINT)) AS DOUBLE) / sum(z.n) / 1e9 AS mean FROM d0 d JOIN z ON z.id = d.id WHERE d.delta IS NOT NULL GROUP BY ALL),
b AS (SELECT pair, metric, round(quantile_cont(mean, 0.025), 6) AS ci95_low, round(quantile_cont(mean, 0.975), 6) AS ci95_high, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero FROM m WHERE NOT isnan(mean) GROUP BY ALL)"""

def _stage_columns(name: str, value: str, when: str) -> str:
    figures = {"mean": "avg({0})", "p50": "quantile_cont({0}, 0.5)", "p95": "quantile_cont({0}, 0.95)"}
    return ", ".join(f"round({f.format(value)} FILTER ({when}), 6) AS {name}_{k}_s" for k, f in figures.items())


_CONDITIONS = f"""{ANSWERED},
q AS (SELECT an.id, reference_answer AS ref, m.model, c.condition, CASE WHEN c.condition = 'rag' THEN texts[len(texts)] ELSE texts[1] END AS doc FROM an, (VALUES ('base'), ('tuned')) m(model), (VALUES ('rag'), ('oracle')) c(condition) WHERE reference_answer <> ''),
s AS (SELECT *, CASE WHEN model = 'base' THEN regexp_extract(doc, '^[^.!?]*[.!?]?') ELSE regexp_extract(doc, '^[^.!?]*[.!?]?[^.!?]*') END AS prediction FROM q),
w AS (SELECT *, {_list('prediction')} AS a, {_list('ref')} AS b FROM s),
r AS (SELECT id, model, condition, CASE WHEN {sql_normal('prediction')} = {sql_normal('ref')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, {_f1('a', 'b')} AS token_f1,
      CASE WHEN {sql_normal('ref')} <> '' AND contains({sql_normal('prediction')}, {sql_normal('ref')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer_containment, length(prediction) AS n FROM w),
cs AS (SELECT model, condition, count(*) AS examples, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(answer_containment), 6) AS answer_containment,
       round(avg(n / 1000), 6) AS model_generate_latency_s_per_example, CAST(sum(n) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(sum(n) AS BIGINT) AS answer_tokens FROM r GROUP BY ALL)"""
_DELTA = "SELECT condition, '{0}' AS metric, max({0}) FILTER (model = 'base') AS base, max({0}) FILTER (model = 'tuned') AS tuned, round(max({0}) FILTER (model = 'tuned') - max({0}) FILTER (model = 'base'), 6) AS delta FROM cs GROUP BY condition"
_PAIR = "SELECT b.condition AS pair, '{0}' AS metric, count(*) AS total, count(b.{0}) AS baseline_numeric, count(t.{0}) AS candidate_numeric, count(t.{0} - b.{0}) AS pairs, 1.0::DOUBLE AS coverage, round(avg(t.{0} - b.{0}), 6) AS delta, TRUE AS eligible FROM r b JOIN r t ON b.id = t.id AND b.condition = t.condition AND b.model = 'base' AND t.model = 'tuned' GROUP BY b.condition"
_BLOCK = "SELECT recipe, '{0}' AS metric, count(*) AS total, count({1}) AS numeric, count(*) FILTER (judge_status = 'ok') AS successes, count(judge_status) - count(*) FILTER (judge_status = 'ok') AS failures, round(count({1}) / count(*), 6) AS coverage, count(*) FILTER (hit AND judge_status IS NOT NULL) AS hits, count(judge_status) - count(*) FILTER (hit AND judge_status IS NOT NULL) AS misses, 0.7::DOUBLE AS minimum_coverage, CASE WHEN count({1}) / count(*) >= 0.7 THEN 'ok' ELSE 'insufficient_coverage' END AS state FROM e GROUP BY recipe"

QUERIES = {f.__name__: f for f in (recipe_summary, stage_latency_percentiles, latency_composition, throughput_ratio, judge_coverage, metric_means_long, recipe_matrix, paired_delta, bootstrap_ci_hash, bootstrap_ci_numpy, comparison_matrix, unpaired_examples, recipe_metrics, score_means, judge_blocks, row_rates, condition_summary, condition_deltas, condition_pairs, thinking_split)}
SQL = {
    "recipe_summary": f"WITH {_EVENTS} SELECT recipe, count(*) AS examples, round(avg(generate_s), 6) AS generate_s, round(avg(judge_correctness), 6) AS judge_correctness, CAST(coalesce(sum(answer_tokens), 0) AS BIGINT) AS answer_tokens_total, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens_total FROM e GROUP BY recipe",
    "stage_latency_percentiles": f"WITH {_EVENTS} " + " UNION ALL ".join(_STAGE.format(s) for s in ("generate_s", "retrieval_s")),
    "latency_composition": f"WITH {_EVENTS} SELECT id, round(coalesce(CASE WHEN answer_tokens % 2 = 0 THEN generate_s END, generate_s + coalesce(retrieval_s, 0)) + 0.5, 6) AS seconds FROM e",
    "throughput_ratio": f"WITH {_EVENTS} SELECT recipe, round(sum(answer_tokens) FILTER (generate_s > 0) / sum(generate_s) FILTER (generate_s > 0 AND answer_tokens IS NOT NULL), 6) AS output_rate, round(sum(answer_tokens + prompt_tokens) FILTER (generate_s > 0) / sum(generate_s) FILTER (generate_s > 0 AND answer_tokens IS NOT NULL), 6) AS total_rate FROM e GROUP BY recipe",
    "judge_coverage": f"""WITH {_EVENTS}, c AS (SELECT recipe, count(*) AS total, count(judge_status) AS attempted, count(*) FILTER (judge_status = 'ok') AS successes, count(*) FILTER (hit) AS hits FROM e GROUP BY recipe)
        SELECT *, attempted - successes AS failures, round(CASE WHEN attempted > 0 THEN successes / total END, 6) AS coverage, round(CASE WHEN attempted > 0 THEN (attempted - successes) / attempted END, 6) AS failure_rate,
        CASE WHEN attempted = 0 THEN 'not_applicable' WHEN successes / total >= 0.8 THEN 'ok' ELSE 'insufficient_coverage' END AS state FROM c""",
    "metric_means_long": f"WITH {_EVENTS} " + " UNION ALL ".join(_MEAN.format(s) for s in ("generate_s", "retrieval_s", "judge_correctness")),
    "recipe_metrics": f"""WITH {_EVENTS}, x AS (SELECT recipe, count(*) AS examples, avg((n % 4 = 0)::INTEGER) AS em, avg(judge_correctness) AS f1, sum(answer_tokens) FILTER (generate_s > 0) / sum(generate_s) FILTER (generate_s > 0 AND answer_tokens IS NOT NULL) AS orate,
        sum(answer_tokens + prompt_tokens) FILTER (generate_s > 0) / sum(generate_s) FILTER (generate_s > 0 AND answer_tokens IS NOT NULL) AS trate, min_by(CAST(n % 8 AS INTEGER), id) AS batch_size, min_by(CASE WHEN n % 2 = 0 THEN 'sampled' ELSE 'greedy' END, id) AS generation_mode,
        sum(prompt_tokens) AS p_sum, sum(answer_tokens) AS a_sum, {_stage_columns('retrieval_latency', 'retrieval_s', 'n % 2 = 0')}, {_stage_columns('model_generate_latency', 'generate_s', 'TRUE')} FROM e GROUP BY recipe)
        SELECT recipe, examples, round(em, 6) AS exact_match, round(f1, 6) AS token_f1, round(orate, 6) AS output_tokens_per_model_generate_second, round(trate, 6) AS total_tokens_per_model_generate_second, batch_size, generation_mode,
        CAST(p_sum AS BIGINT) AS prompt_tokens_total, CAST(a_sum AS BIGINT) AS output_tokens_total, CAST(0 AS BIGINT) AS reasoning_tokens_total, CAST(a_sum AS BIGINT) AS answer_tokens_total,
        retrieval_latency_mean_s, retrieval_latency_p50_s, retrieval_latency_p95_s, model_generate_latency_mean_s, model_generate_latency_p50_s, model_generate_latency_p95_s,
        model_generate_latency_mean_s AS latency_mean_s, model_generate_latency_p50_s AS latency_p50_s, model_generate_latency_p95_s AS latency_p95_s, round(orate, 6) AS tokens_per_second FROM x""",
    "score_means": f"WITH {_EVENTS} SELECT recipe, 'grounded' AS metric, count(*) AS numeric, round(avg(abs(generate_s) / 10), 6) AS mean FROM e GROUP BY recipe UNION ALL SELECT recipe, 'cited', count(*), round(avg(0.5 + answer_tokens / 100), 6) FROM e WHERE n % 3 = 0 GROUP BY recipe",
    "judge_blocks": f"WITH {_EVENTS} " + " UNION ALL ".join(_BLOCK.format(m, v) for m, v in (("judge_correctness", "judge_correctness"), ("judge_groundedness", "CASE WHEN judge_status = 'ok' THEN judge_correctness END"), ("judge_unsupported_claim_rate", "CAST(NULL AS DOUBLE)"))),
    "row_rates": f"WITH {_EVENTS} SELECT id, CASE WHEN generate_s > 0 THEN round(answer_tokens / generate_s, 6) END AS output_rate, CASE WHEN generate_s > 0 THEN round((answer_tokens + prompt_tokens) / generate_s, 6) END AS total_rate FROM e",
    "condition_summary": f"WITH {_CONDITIONS} SELECT * FROM cs",
    "condition_deltas": f"WITH {_CONDITIONS} " + " UNION ALL ".join(_DELTA.format(m) for m in measures.CONDITION_METRICS),
    "condition_pairs": f"WITH {_CONDITIONS} " + " UNION ALL ".join(_PAIR.format(m) for m in METRICS),
    "recipe_matrix": f"WITH {_PREDICTIONS} SELECT * FROM p",
    "paired_delta": f"WITH {_DELTAS} {_SUMMARY}",
    "bootstrap_ci_hash": f"WITH {_BOOT} SELECT * FROM b",
    "comparison_matrix": f"""WITH {_BOOT}, su AS ({_SUMMARY})
        SELECT su.pair, su.metric, pairs, su.delta, ci95_low, ci95_high, CASE WHEN su.pair = 'sft-rag->raft-rag' THEN 'confounded_training_controls' WHEN pairs = 0 THEN 'insufficient_coverage' ELSE 'ok' END AS status,
        su.pair <> 'sft-rag->raft-rag' AND pairs > 0 AS eligible, su.pair <> 'sft-rag->raft-rag' AND pairs > 0 AND coalesce(excludes_zero, FALSE) AS significant FROM su LEFT JOIN b ON b.pair = su.pair AND b.metric = su.metric""",
    "unpaired_examples": f"""WITH {ANSWERED}, s AS (SELECT id, {NUMBER} % 3 = 0 AS lost FROM an)
        SELECT pair, id, CAST(1 AS BIGINT) AS n_baseline, CAST(0 AS BIGINT) AS n_candidate FROM s, (VALUES ('rag->raft-rag'), ('sft-rag->raft-rag')) x(pair) WHERE lost""",
    "thinking_split": """WITH t AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 2 AS b, event_id % 5 <> 0 AS closed FROM events)
        SELECT event_id, CAST(CASE WHEN closed THEN b ELSE 0 END AS BIGINT) AS n_reasoning, CAST(CASE WHEN closed THEN 2 ELSE 0 END AS BIGINT) AS n_answer, CAST(b + CASE WHEN closed THEN 1 ELSE 0 END + 2 AS BIGINT) AS n_output,
        CASE WHEN NOT closed THEN 'missing boundary' END AS problem FROM t""",
}
