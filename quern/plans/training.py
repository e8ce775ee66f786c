"""Queries on records, splits and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import prompts
from quern.operators import records, splits, tuning
from quern.plans.common import BLANKS, EVAL, NUMBER, SEED, TRAIN, documents, examples, sql_clean, sql_hash, sql_key
from quern.runtime import Stash, table

RATIO = 0.1


def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "train_qa", "eval", "sft")
    parts = [records.repeated_ids(table(spark, sf_dir, n)).select(F.lit(n).alias("tbl"), "id", "n") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of all record types; an answer to tune on may not be blank."""
    output = {"blank_output": F.trim("output", F.lit(records.BLANKS)) != ""}
    parts = [
        records.violations(table(spark, sf_dir, "documents"), records.document_rules()).select(F.lit("documents").alias("tbl"), "id", "rule"),
        records.violations(examples(spark, sf_dir, "train_qa"), records.question_rules()).select(F.lit("train_qa").alias("tbl"), "id", "rule"),
        records.violations(examples(spark, sf_dir), records.question_rules()).select(F.lit("eval").alias("tbl"), "id", "rule"),
        records.violations(examples(spark, sf_dir, "sft"), output).select(F.lit("sft").alias("tbl"), "id", "rule"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.missing_references(examples(spark, sf_dir), documents(spark, sf_dir))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.split_conflicts(examples(spark, sf_dir, "train_qa"), examples(spark, sf_dir))


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    return rows.select("id", F.array_join(records.merged_evidence(F.col("relevant_doc_ids"), F.col("evidence")), " ").alias("doc_ids"))


def raft_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples whose contexts are their listed documents, every second one marked relevant, with all of them as evidence."""
    rows = examples(spark, sf_dir, "train_qa").select("id", F.col("relevant_doc_ids").alias("raw"), records.clean_ids(F.col("relevant_doc_ids")).alias("refs"))
    contexts = F.transform("refs", lambda d, i: F.struct(d.alias("doc_id"), (i % 2 == 0).alias("relevant")))
    problems = records.raft_problems(contexts, F.col("refs"))
    return rows.select("id", F.array_join(problems, "; ").alias("problems"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stash(spark).put(splits.question_groups(examples(spark, sf_dir, "train_qa"), ("metadata.author",), by_document=True))


def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_rows(examples(spark, sf_dir, "train_qa"), RATIO, SEED).select("id", "split")


def _question_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stash(spark).put(splits.question_groups(examples(spark, sf_dir, "train_qa")))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_groups(_question_groups(spark, sf_dir), RATIO, SEED)


def document_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = splits.split_groups(_question_groups(spark, sf_dir), RATIO, SEED)
    return splits.document_pools(documents(spark, sf_dir), assigned, examples(spark, sf_dir, "train_qa"), RATIO, SEED)


def partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir, "train_qa")
    return splits.audit(rows, Stash(spark).put(splits.split_rows(rows, RATIO, SEED)))


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.source_fingerprints(examples(spark, sf_dir), "reference_answer")


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.table_fingerprint(source_fingerprint(spark, sf_dir))


def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir, "sft").select("id", "instruction", "input", "output")
    return splits.row_fingerprints(rows)


def _tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir, "sft").where(F.trim("output", F.lit(records.BLANKS)) != "")


def completions_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tuning.completions(_tuning(spark, sf_dir), "sft", chat=False)
    return rows.select("id", F.sha2("prompt", 256).alias("prompt"), F.sha2("completion", 256).alias("completion"))


def completions_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tuning.completions(_tuning(spark, sf_dir), "sft", chat=True)
    part = lambda c: F.concat_ws("|", F.get(c, F.lit(0))["role"], F.sha2(F.get(c, F.lit(0))["content"], 256))
    return rows.select("id", part(F.col("prompt")).alias("prompt"), part(F.col("completion")).alias("completion"))


def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training questions with an answer, of every fourth number, as tuning rows of the same sources."""
    train = examples(spark, sf_dir, "train_qa")
    chosen = train.where(F.trim("reference_answer", F.lit(records.BLANKS)) != "").where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 4 == 0)
    return tuning.matched(chosen.select("id"), train).select("id", "instruction", "input", "output")


def training_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and questions that tuning rows and training questions have in common."""
    sft = examples(spark, sf_dir, "sft").select("id", "input")
    return records.training_conflicts(sft, examples(spark, sf_dir, "train_qa")).where("kind = 'question'").select("value", "n_one", "n_other")


def positive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    return rows.select("id", F.array_join(records.document_ids(rows), " ").alias("documents"))


def ungrouped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ungrouped(examples(spark, sf_dir, "train_qa"), ("metadata.author", "metadata.split"))


def _blank(column: str) -> str:
    return f"coalesce(trim({column}, {BLANKS}), '') = ''"


_RESPONSE = repr(prompts.RESPONSE).replace("\\n", "\n")
_TUNED = f"""s AS (SELECT DISTINCT ON (id) id, coalesce(input, '') AS q, output FROM sft WHERE id IS NOT NULL AND NOT {_blank('output')}),
t AS (SELECT id, output, '### Instruction\n{prompts.INSTRUCTION}\n\n### Question\n' || q || '\n\n### Documents\n{prompts.NO_DOCUMENTS}' AS t FROM s)"""
_KEY = sql_key("question")
_GROUPED = f"""{TRAIN},
keys AS (SELECT id, {_KEY} AS k FROM tr WHERE {_KEY} <> ''),
g AS (SELECT tr.id, coalesce(k.g, tr.id) AS "group" FROM tr LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY k) AS g FROM keys) k ON k.id = tr.id)"""


def _assigned(groups: str) -> str:
    """The split a (id, group, split) of the rows g (id, group): whole groups by hash until a tenth of the rows is reached."""
    return f"""{groups},
z AS (SELECT "group", count(*) AS size, {sql_hash("'42'", '"group"')} AS h FROM g GROUP BY "group"),
o AS (SELECT *, sum(size) OVER (ORDER BY h, "group" ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY h, "group") AS nth FROM z),
a AS (SELECT g.id, g."group", CASE WHEN before < greatest(1, round_even((SELECT count(*) FROM g) * 0.1, 0)) AND nth < (SELECT count(*) FROM z) THEN 'validation' ELSE 'train' END AS split FROM g JOIN o ON o."group" = g."group")"""


_ROWS = f'{TRAIN}, g AS (SELECT id, id AS "group" FROM tr)'
_PRINTS = f"""{EVAL}, f AS (SELECT id, sha256(concat_ws(chr(31), id, coalesce({_KEY}, ''), coalesce(reference_answer, ''))) AS fingerprint FROM ev)"""

QUERIES = {f.__name__: f for f in (id_uniqueness, record_violations, referential_check, split_overlap, evidence_merge, raft_invariant, connected_groups, row_split, group_split, document_pools, partition_audit, source_fingerprint, table_fingerprint, row_fingerprint, completions_plain, completions_chat, matched_rows, training_conflicts, positive_documents, ungrouped_records)}
SQL = {
    "id_uniqueness": " UNION ALL ".join(f"SELECT '{t}' AS tbl, id, count(*) AS n FROM {t} GROUP BY id HAVING count(*) > 1" for t in ("documents", "train_qa", "eval", "sft")),
    "record_violations": f"""SELECT 'documents' AS tbl, id, 'blank_id' AS rule FROM documents WHERE {_blank('id')} UNION ALL SELECT 'documents', id, 'blank_text' FROM documents WHERE {_blank('text')}
        UNION ALL SELECT DISTINCT 'train_qa', id, 'blank_id' FROM train_qa WHERE id IS NOT NULL AND {_blank('id')} UNION ALL SELECT DISTINCT 'train_qa', id, 'empty_question' FROM train_qa WHERE id IS NOT NULL AND coalesce(question, '') = ''
        UNION ALL SELECT DISTINCT 'eval', id, 'blank_id' FROM eval WHERE id IS NOT NULL AND {_blank('id')} UNION ALL SELECT DISTINCT 'eval', id, 'empty_question' FROM eval WHERE id IS NOT NULL AND coalesce(question, '') = ''
        UNION ALL SELECT DISTINCT 'sft', id, 'blank_output' FROM sft WHERE id IS NOT NULL AND {_blank('output')}""",
    "referential_check": f"WITH {EVAL}, x AS (SELECT id, unnest({sql_clean('relevant_doc_ids')}) AS ref_id FROM ev) SELECT ref_id, count(*) AS n_records FROM x WHERE ref_id NOT IN (SELECT id FROM documents WHERE id IS NOT NULL) GROUP BY ref_id",
    "split_overlap": f"""WITH {TRAIN}, {EVAL},
        a AS (SELECT 'id' AS kind, id AS value FROM tr UNION ALL SELECT 'question', {_KEY} FROM tr WHERE {_KEY} <> ''),
        b AS (SELECT 'id' AS kind, id AS value FROM ev UNION ALL SELECT 'question', {_KEY} FROM ev WHERE {_KEY} <> '')
        SELECT * FROM (SELECT kind, value, count(*) AS n_one FROM a GROUP BY ALL) JOIN (SELECT kind, value, count(*) AS n_other FROM b GROUP BY ALL) USING (kind, value)""",
    "evidence_merge": f"""WITH {EVAL}, m AS (SELECT id, list_concat({sql_clean('relevant_doc_ids')}, {sql_clean("list_transform(coalesce(evidence, []), lambda e: e.doc_id)")}) AS l FROM ev)
        SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS doc_ids FROM m""",
    "raft_invariant": f"""WITH {TRAIN}, c AS (SELECT id, len({sql_clean('relevant_doc_ids')}) AS n FROM tr)
        SELECT id, CASE WHEN n = 0 THEN 'no contexts; no evidence; nothing relevant' WHEN n = 1 THEN '' ELSE 'evidence marked irrelevant; evidence differs from relevant contexts' END AS problems FROM c""",
    "connected_groups": f"""WITH RECURSIVE {TRAIN}, keys AS (
            SELECT id, 'author=' || metadata.author AS k FROM tr WHERE metadata.author <> '' UNION SELECT id, 'q=' || {_KEY} FROM tr WHERE {_KEY} <> ''
            UNION SELECT id, 'd=' || unnest({sql_clean('relevant_doc_ids')}) FROM tr),
        ties AS (SELECT DISTINCT id, min(id) OVER (PARTITION BY k) AS least FROM keys),
        edges AS (SELECT id AS a, least AS b FROM ties UNION SELECT least, id FROM ties),
        reach AS (SELECT DISTINCT id AS node, id AS root FROM tr UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
        SELECT node AS id, min(root) AS "group" FROM reach GROUP BY node""",
    "row_split": f"WITH {_assigned(_ROWS)} SELECT id, split FROM a",
    "group_split": f'WITH {_assigned(_GROUPED)} SELECT id, "group", split FROM a',
    "document_pools": f"""WITH {_assigned(_GROUPED)},
        u AS (SELECT ref, CASE WHEN min(split) = max(split) THEN min(split) ELSE 'both' END AS pool FROM (SELECT unnest({sql_clean('tr.relevant_doc_ids')}) AS ref, a.split FROM tr JOIN a ON a.id = tr.id) GROUP BY ref),
        n AS (SELECT id, row_number() OVER (ORDER BY {sql_hash("'42'", 'id')}, id) AS nth, count(*) OVER () AS c FROM documents WHERE id NOT IN (SELECT ref FROM u))
        SELECT d.id AS doc_id, pool FROM documents d JOIN u ON u.ref = d.id UNION ALL SELECT id, CASE WHEN nth <= round_even(c * 0.1, 0) THEN 'validation' ELSE 'train' END FROM n""",
    "partition_audit": f"""WITH {_assigned(_ROWS)},
        q AS (SELECT count(*) AS n FROM (SELECT {_KEY} AS k FROM tr JOIN a USING (id) WHERE {_KEY} <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1)),
        d AS (SELECT count(*) AS n FROM (SELECT ref FROM (SELECT unnest({sql_clean('relevant_doc_ids')}) AS ref, split FROM tr JOIN a USING (id)) GROUP BY 1 HAVING count(DISTINCT split) > 1))
        SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS validation_rows, count(DISTINCT "group") AS groups,
        CAST(0 AS BIGINT) AS group_overlap, (SELECT n FROM q) AS question_overlap, (SELECT n FROM d) AS document_overlap FROM a""",
    "source_fingerprint": f"WITH {_PRINTS} SELECT id, fingerprint FROM f",
    "completions_plain": f"WITH {_TUNED} SELECT id, sha256(t || {_RESPONSE}) AS prompt, sha256(output) AS completion FROM t",
    "completions_chat": f"WITH {_TUNED} SELECT id, 'user|' || sha256(t) AS prompt, 'assistant|' || sha256(output) AS completion FROM t",
    "matched_rows": f"WITH {TRAIN} SELECT id, '{tuning.INSTRUCTION}' AS instruction, question AS input, reference_answer AS output FROM tr WHERE NOT {_blank('reference_answer')} AND {NUMBER} % 4 = 0",
    "training_conflicts": f"""WITH {TRAIN}, s AS (SELECT DISTINCT ON (id) id, coalesce(input, '') AS question FROM sft WHERE id IS NOT NULL),
        a AS (SELECT {sql_key('question')} AS value, count(*) AS n_one FROM s GROUP BY 1), b AS (SELECT {sql_key("coalesce(question, '')")} AS value, count(*) AS n_other FROM tr GROUP BY 1)
        SELECT a.value, n_one, n_other FROM a JOIN b ON a.value = b.value AND a.value <> ''""",
    "positive_documents": f"WITH {EVAL}, x AS (SELECT id, {sql_clean("list_concat(coalesce(relevant_doc_ids, []), coalesce(list_transform(evidence, lambda e: e.doc_id), []))")} AS d FROM ev) SELECT id, array_to_string(d, ' ') AS documents FROM x",
    "ungrouped_records": f"WITH {TRAIN} SELECT id, 'metadata.author' AS field FROM tr WHERE coalesce(metadata.author, '') = '' UNION ALL SELECT id, 'metadata.split' FROM tr WHERE coalesce(metadata.split, '') = ''",
    "row_fingerprint": "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM sft WHERE id IS NOT NULL) WHERE rn = 1) SELECT id, sha256('{' || " + " || ',' || ".join(f"""'"{c}":' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null')""" for c in ("id", "input", "instruction", "output")) + " || '}') AS fingerprint FROM s",
    "table_fingerprint": f"WITH {_PRINTS}, l0 AS (SELECT fingerprint AS name, fingerprint AS f, 1 AS n FROM f), "
    + ", ".join(f"l{i + 1} AS (SELECT substr(name, 1, {d}) AS name, sha256(string_agg(f, chr(10) ORDER BY name)) AS f, sum(n) AS n FROM l{i} GROUP BY 1)" for i, d in enumerate(splits.LEVELS))
    + f" SELECT f AS fingerprint, CAST(n AS BIGINT) AS n FROM l{len(splits.LEVELS)}",
}
