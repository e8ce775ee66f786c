"""What the queries share: deduplicated examples, the stand-in generator, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import SQL_KEY, SQL_NORMAL, SQL_WORDS
from quern.operators.records import clean_ids, deliveries_once
from quern.runtime import table

SEED = 42
TOP_K = 5

BLANKS = "(chr(32) || chr(9) || chr(13) || chr(10))"
EVAL = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM eval WHERE id IS NOT NULL) WHERE rn = 1)"
TRAIN = "tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM train_qa WHERE id IS NOT NULL) WHERE rn = 1)"
NUMBER = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)"


def sql_clean(column: str) -> str:
    """A list without blanks around its entries and without null, blank and repeated ones, in order."""
    kept = f"list_filter(list_transform(coalesce({column}, []), lambda x: trim(x, {BLANKS})), lambda x: x IS NOT NULL AND x <> '')"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


def sql_words(column: str) -> str:
    return SQL_WORDS.format(column)


def sql_normal(column: str) -> str:
    return SQL_NORMAL.format(column)


def sql_key(column: str) -> str:
    return SQL_KEY.format(column)


def sql_hash(*parts: str, digits: int = 15) -> str:
    """The first hexadecimal digits of the SHA-256 of the parts joined by colons, as a number."""
    return f"CAST('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, {digits}) AS BIGINT)"


#: The first sentence of the first relevant document there is: what the stand-in generator answers with the gold context.
ANSWERED = f"""{EVAL},
refs AS (SELECT id, question, reference_answer, {sql_clean('relevant_doc_ids')} AS refs FROM ev),
ctx AS (SELECT r.id, list(d.id ORDER BY r.i) AS ids, list(d.text ORDER BY r.i) AS texts
        FROM (SELECT id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS i FROM refs) r JOIN documents d ON d.id = r.ref GROUP BY r.id),
an AS (SELECT r.*, ctx.ids, ctx.texts, regexp_extract(ctx.texts[1], '^[^.!?]*[.!?]?') AS prediction FROM refs r JOIN ctx ON ctx.id = r.id)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("pos", F.col("doc_id"))


def examples(spark: SparkSession, sf_dir: str, name: str = "eval") -> DataFrame:
    return deliveries_once(table(spark, sf_dir, name))


def relevant(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the examples' cleaned references."""
    return rows.select(F.col("id").alias("query_id"), F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("doc_id"))


def gold_contexts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, ids, texts): the relevant documents that exist, in the order in which the example lists them."""
    refs = rows.select("id", F.posexplode(clean_ids(F.col("relevant_doc_ids"))).alias("i", "ref"))
    found = refs.join(docs.select(F.col("id").alias("ref"), "text"), "ref")
    listed = F.array_sort(F.collect_list(F.struct("i", "ref", "text")))
    return found.groupBy("id").agg(listed.alias("c")).select("id", F.transform("c", lambda x: x["ref"]).alias("ids"), F.transform("c", lambda x: x["text"]).alias("texts"))


def first_sentence(text: F.Column) -> F.Column:
    return F.regexp_extract(text, r"^[^.!?]*[.!?]?", 0)


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, reference_answer, refs, ids, texts, prediction) of the evaluation examples with documents."""
    rows = examples(spark, sf_dir)
    base = rows.select("id", "question", "reference_answer", clean_ids(F.col("relevant_doc_ids")).alias("refs"))
    return base.join(gold_contexts(rows, documents(spark, sf_dir)), "id").withColumn("prediction", first_sentence(F.get("texts", F.lit(0))))
