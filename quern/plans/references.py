"""Queries on references to records that do not exist (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.orphans import OrphanState, advance, empty_state, explode_references, open_orphans, parent_index, snapshot
from quern.runtime import Stash, table


def _state(spark: SparkSession, sf_dir: str) -> OrphanState:
    """The tracker's state after train_qa, then the documents, then eval: waiting, resolving and probing all take part."""
    stash = Stash(spark)
    state = advance(empty_state(spark), references=explode_references(table(spark, sf_dir, "train_qa"), "train_qa"), stash=stash)
    state = advance(state, parents=parent_index(table(spark, sf_dir, "documents")), stash=stash)
    return advance(state, references=explode_references(table(spark, sf_dir, "eval"), "eval"), stash=stash)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_orphans(_state(spark, sf_dir))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(_state(spark, sf_dir))


_REFERENCES = """
refs AS (
  SELECT tbl, id, ref_id, min(created_at) AS created_at
  FROM (SELECT 'train_qa' AS tbl, id, created_at, trim(unnest(relevant_doc_ids), chr(32) || chr(9) || chr(13) || chr(10)) AS ref_id FROM train_qa
        UNION ALL
        SELECT 'eval', id, created_at, trim(unnest(relevant_doc_ids), chr(32) || chr(9) || chr(13) || chr(10)) FROM eval)
  WHERE ref_id <> '' AND id IS NOT NULL GROUP BY 1, 2, 3),
kinds AS (
  SELECT r.*, CASE WHEN d.id IS NULL THEN 'missing' WHEN d.added_at > r.created_at THEN 'late' WHEN d.deleted_at <= r.created_at THEN 'deleted' END AS kind
  FROM refs r LEFT JOIN documents d ON d.id = r.ref_id)
"""

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL = {
    "p7_found": f"WITH {_REFERENCES} SELECT tbl, id, ref_id, kind FROM kinds WHERE kind IS NOT NULL",
    "p7_counts": f"""WITH {_REFERENCES} SELECT tbl, strftime(created_at, '%Y-%m') AS month, count(*) AS n_references,
        count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'late') AS n_late, count(*) FILTER (kind = 'deleted') AS n_deleted
        FROM kinds GROUP BY 1, 2""",
}
