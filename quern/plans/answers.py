"""Queries on texts, prompts and scores of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import prompts, text
from quern.operators import scoring
from quern.plans.common import ANSWERED, EVAL, answered, examples, sql_key, sql_normal
from quern.runtime import table


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"), F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_words"))


def question_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).select("id", text.question_key(F.col("question")).alias("key"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_id("ctx", F.col("text")).alias("content_id"))


def exact_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answered(spark, sf_dir).where("reference_answer is not null and prediction is not null")
    p, r = F.col("prediction"), F.col("reference_answer")
    return rows.select("id", text.exact_match(p, r).alias("exact_match"), F.round(text.token_f1(p, r), 6).alias("token_f1"))


def answer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first relevant document contains the reference answer."""
    rows = answered(spark, sf_dir)
    return rows.select("id", text.contains_answer(F.get("texts", F.lit(0)), text.references(F.lit(None).cast("array<string>"), F.col("reference_answer"))).alias("contained"))


def _scored(spark: SparkSession, sf_dir: str, scorer: scoring.Scorer) -> DataFrame:
    rows = answered(spark, sf_dir).select("id", F.coalesce("reference_answer", F.lit("")).alias("answer"), F.col("texts").alias("contexts"), F.col("ids").alias("context_ids"), F.col("refs").alias("relevant_doc_ids"), F.array("reference_answer").alias("refs"))
    out = scoring.score(rows, scorer)
    return out.select("id", *(F.round(c, 6).alias(c) for c in scorer.columns()))


def lexical_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, scoring.Groundedness())


def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers' [Document N] marks against the documents that the example lists, of which the first is held relevant."""
    rows = answered(spark, sf_dir).select("id", F.coalesce("reference_answer", F.lit("")).alias("answer"), F.col("ids").alias("context_ids"), F.slice("ids", 1, 1).alias("relevant_doc_ids"))
    scorer = scoring.Citations()
    return scoring.score(rows, scorer).select("id", *(F.round(c, 6).alias(c) for c in scorer.columns()))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answered(spark, sf_dir)
    full, bare = prompts.prompt(F.col("question"), F.col("texts")), prompts.prompt(F.col("question"), F.array().cast("array<string>"))
    return rows.select("id", F.sha2(full, 256).alias("with_documents"), F.sha2(bare, 256).alias("without_documents"))


def training_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion of the tuning pairs, as one text without documents; pairs without an output are left out."""
    rows = examples(spark, sf_dir, "sft").where("trim(output) <> ''")
    whole = prompts.training_text(F.coalesce("input", F.lit("")), F.array().cast("array<string>"), F.col("output"))
    return rows.select("id", F.sha2(whole, 256).alias("digest"), F.char_length(whole).cast("bigint").alias("n_chars"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found in texts that say something around them."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Result: "), "props", F.lit(" as asked."))).otherwise(F.col("props")).alias("said"))
    return rows.select("event_id", F.get_json_object(text.lenient_json(F.col("said")), "$.k").cast("bigint").alias("k"))


def judge_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct judge requests that a cache of every third example lacks."""
    rows = examples(spark, sf_dir).where("reference_answer is not null").select("id", F.sha2(F.concat_ws("|", F.lit(scoring.JUDGE_PROMPT), "question", "reference_answer"), 256).alias("key"))
    cache = rows.where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 3 == 0)
    return rows.select("key").distinct().join(cache.select("key"), "key", "left_anti")


_PROMPT = "'### Instruction\n" + prompts.INSTRUCTION + "\n\n### Question\n' || {q} || '\n\n### Documents\n' || {c}"
_NUMBERED = "list_aggregate(list_transform(texts, lambda t, i: '[Document ' || i || ']\n' || t), 'string_agg', '\n\n')"
_SHARE = "len(list_filter({w}, lambda w: list_contains(k, w))) / len({w})"


def _words(expression: str) -> str:
    return f"list_filter(string_split({sql_normal(expression)}, ' '), lambda z: z <> '')"


QUERIES = {f.__name__: f for f in (text_normalize, question_normalize, content_ids, exact_match_f1, answer_containment, lexical_groundedness, citation_scores, prompt_render, training_format, lenient_json, judge_cache_misses)}
SQL = {
    "text_normalize": f"SELECT doc_id, md5({sql_normal('text')}) AS digest, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS n_words FROM documents",
    "question_normalize": f"WITH {EVAL} SELECT id, {sql_key('question')} AS key FROM ev",
    "content_ids": "SELECT doc_id, 'ctx-' || substr(sha256(text), 1, 16) AS content_id FROM documents",
    "exact_match_f1": f"""WITH {ANSWERED},
        w AS (SELECT id, {_words('prediction')} AS p, {_words('reference_answer')} AS r, {sql_normal('prediction')} = {sql_normal('reference_answer')} AS same FROM an WHERE reference_answer IS NOT NULL AND prediction IS NOT NULL),
        c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0) AS n FROM w)
        SELECT id, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
        round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN CASE WHEN len(p) = len(r) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / (len(p) + len(r)) END, 6) AS token_f1 FROM c""",
    "answer_containment": f"WITH {ANSWERED} SELECT id, CASE WHEN coalesce({sql_normal('reference_answer')}, '') <> '' AND contains({sql_normal('texts[1]')}, {sql_normal('reference_answer')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS contained FROM an",
    "lexical_groundedness": f"""WITH {ANSWERED},
        k AS (SELECT id, {_words("list_aggregate(texts, 'string_agg', ' ')")} AS k, {_words("coalesce(reference_answer, '')")} AS a,
              list_filter(list_transform(regexp_split_to_array(coalesce(reference_answer, ''), '[.!?;]+|\\n+'), lambda c: {sql_normal('c')}), lambda c: c <> '') AS cl FROM an)
        SELECT id, round(CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE {_SHARE.format(w='a')} END, 6) AS lexical_groundedness,
        round(CASE WHEN len(cl) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(cl, lambda c: {_SHARE.format(w="string_split(c, ' ')")} < 0.5)) / len(cl) END, 6) AS lexical_unsupported_claim_rate FROM k""",
    "citation_scores": f"""WITH {ANSWERED},
        c AS (SELECT id, ids, list_distinct(list_transform(regexp_extract_all(coalesce(reference_answer, ''), '(?i)\\[\\s*document\\s+(\\d+)\\s*\\]', 1), lambda n: CAST(n AS BIGINT))) AS n FROM an)
        SELECT id, round(CASE WHEN len(n) > 0 THEN (CASE WHEN list_contains(n, 1) THEN 1 ELSE 0 END) / len(n) END, 6) AS citation_precision,
        round((CASE WHEN list_contains(n, 1) THEN 1 ELSE 0 END)::DOUBLE, 6) AS citation_recall FROM c""",
    "prompt_render": f"WITH {ANSWERED} SELECT id, sha256({_PROMPT.format(q='question', c=_NUMBERED)}) AS with_documents, sha256({_PROMPT.format(q='question', c=repr(prompts.NO_DOCUMENTS))}) AS without_documents FROM an",
    "training_format": f"""WITH s AS (SELECT id, coalesce(input, '') AS q, output FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM sft WHERE id IS NOT NULL) WHERE rn = 1 AND trim(output, ' ') <> ''),
        t AS (SELECT id, {_PROMPT.format(q='q', c=repr(prompts.NO_DOCUMENTS))} || '\n\n### Response\n' || output AS t FROM s)
        SELECT id, sha256(t) AS digest, length(t) AS n_chars FROM t""",
    "lenient_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "judge_cache_misses": f"""WITH {EVAL}, k AS (SELECT id, sha256(concat_ws('|', '{scoring.JUDGE_PROMPT}', question, reference_answer)) AS key FROM ev WHERE reference_answer IS NOT NULL)
        SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 3 = 0)""",
}
