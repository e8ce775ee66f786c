"""Corpora and questions from a public question-answering table (context, question, answers, title)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import SPACES, content_id
from quern.sources.config import COMMIT


def pinned(spark: SparkSession, root: str, dataset: str, revision: str) -> DataFrame:
    """The table of a public dataset at one revision, as its files lie under root/dataset/revision; the revision must be a commit."""
    if not dataset.strip() or not COMMIT.fullmatch(revision):
        raise ValueError("a dataset needs its name and the 40 hexadecimal digits of a commit")
    return spark.read.parquet(f"{root.rstrip('/')}/{dataset}/{revision}")


def one_line(text: Column) -> Column:
    """Runs of white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def sample_contexts(rows: DataFrame, count: int, seed: int = 42, exclude: Iterable[str] = (), max_chars: int = 4000) -> DataFrame:
    """``count`` questions with distinct contexts: (doc_id, context, title, question, answers), in a seeded random order.

    Contexts are put on one line. Rows without an answer, with a longer context, or whose context's id is excluded are
    passed over; of the questions of one context the first in that order is taken. Too few raise an error.
    """
    answers = F.array_distinct(F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != ""))
    clean = rows.select(one_line(F.col("context")).alias("context"), "title", one_line(F.col("question")).alias("question"), answers.alias("answers"))
    clean = clean.where((F.size("answers") > 0) & (F.char_length("context") <= max_chars) & (F.col("context") != "") & (F.col("question") != ""))
    clean = clean.withColumn("doc_id", content_id("ctx", F.col("context"))).where(~F.col("doc_id").isin(list(exclude)) if exclude else F.lit(True))
    clean = clean.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "doc_id", "question"), 256))
    first = clean.groupBy("doc_id").agg(F.min_by(F.struct("context", "title", "question", "answers", "h"), "h").alias("r")).select("doc_id", "r.*")
    taken = first.orderBy("h").limit(count)
    if taken.count() < count:
        raise ValueError(f"fewer than {count} contexts are usable")
    return taken.select("doc_id", "context", "title", "question", "answers")


def as_documents(sampled: DataFrame) -> DataFrame:
    """(id, text, metadata, pos) of the sampled contexts; metadata is JSON with the title."""
    pos = F.row_number().over(Window.orderBy("doc_id")) - 1  # a sample, bounded by its count
    return sampled.select(F.col("doc_id").alias("id"), F.col("context").alias("text"), F.to_json(F.struct("title")).alias("metadata"), pos.cast("bigint").alias("pos"))


def as_questions(sampled: DataFrame, prefix: str = "q") -> DataFrame:
    """(id, question, reference_answer, reference_answers, relevant_doc_ids) of the sampled questions."""
    return sampled.select(content_id(prefix, F.concat_ws("\n", "doc_id", "question")).alias("id"), "question", F.get("answers", F.lit(0)).alias("reference_answer"), F.col("answers").alias("reference_answers"), F.array("doc_id").alias("relevant_doc_ids"))
