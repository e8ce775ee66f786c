"""References to records that do not exist, kept up to date as references, parents and deletions arrive.

The state is keyed by what a reference points to. New references probe the parent index; parents that arrive or change
are joined with the references that wait for them, so an arrival resolves orphans and a deletion reopens references.
In streams the state lies in buckets, and a batch reads and writes only those that its ids fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import Stash, join_unique

BLANKS = " \t\r\n"
PARENTS = "ref_id string, added_at timestamp, deleted_at timestamp"
REFERENCES = "tbl string, id string, ref_id string, created_at timestamp, kind string"


@dataclass(frozen=True)
class OrphanState:
    """parents: the index of what exists; references: every reference with its kind, null while it is sound."""

    parents: DataFrame
    references: DataFrame


def explode_references(records: DataFrame, tbl: str, ids: str = "relevant_doc_ids") -> DataFrame:
    """Rows (tbl, id, ref_id, created_at), one for each distinct entry of a record's list.

    Blanks around an entry are removed; null and blank entries, null lists and records with a null id give no row.
    Repeated deliveries of a record count once, with the earliest created_at. Other columns are ignored.
    """
    ref = F.trim(F.col("entry"), F.lit(BLANKS))
    rows = records.select("id", "created_at", F.explode(ids).alias("entry")).select(F.lit(tbl).alias("tbl"), "id", ref.alias("ref_id"), "created_at")
    rows = rows.where("id is not null and ref_id is not null and ref_id <> ''")
    return rows.groupBy("tbl", "id", "ref_id").agg(F.min("created_at").alias("created_at"))


def parent_index(documents: DataFrame, key: str = "id") -> DataFrame:
    """Rows (ref_id, added_at, deleted_at), one for each id: the earliest arrival, and the latest deletion if none is null.

    A null arrival means that it was always there; documents without id are no parents.
    """
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("ref_id"), "added_at", "deleted_at")
    return _merged(rows)


def _merged(rows: DataFrame) -> DataFrame:
    known = rows.groupBy("ref_id").agg(
        F.min("added_at").alias("added_at"),
        F.max("deleted_at").alias("deleted_at"),
        F.max(F.col("added_at").isNull()).alias("always"),
        F.max(F.col("deleted_at").isNull()).alias("there"),
    )
    return known.select("ref_id", F.when(~F.col("always"), F.col("added_at")).alias("added_at"), F.when(~F.col("there"), F.col("deleted_at")).alias("deleted_at"))


def _kind(found: str = "found") -> F.Column:
    return (
        F.when(F.col(found).isNull(), "missing")
        .when(F.col("added_at") > F.col("created_at"), "late")
        .when(F.col("deleted_at") <= F.col("created_at"), "deleted")
    )


def _probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """references (tbl, id, ref_id, created_at) with their kind; many references to one parent don't move."""
    keys = references.groupBy("ref_id").agg(F.count("*").alias("n_rows"))
    index = keys.join(parents.withColumn("found", F.lit(True)), "ref_id", "left")
    total = keys.agg(F.sum("n_rows")).first()[0] or 0
    joined = join_unique(references, index, "ref_id", total, how="inner")
    return joined.select("tbl", "id", "ref_id", "created_at", _kind().alias("kind"))


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark.createDataFrame([], PARENTS), spark.createDataFrame([], REFERENCES))


def advance(state: OrphanState, references: DataFrame | None = None, parents: DataFrame | None = None, stash: Stash | None = None) -> OrphanState:
    """The state after a batch of new references and of new or changed parents; either may be absent.

    references: rows of explode_references; those already known are left as they are. parents: rows (ref_id, added_at,
    deleted_at); a known parent is replaced by the new row, which is how deletions come in. With a stash, the new state
    is written to the shared folder, so that the lineage doesn't grow with the batches.
    """
    index, kept = state.parents, state.references
    if parents is not None:
        fresh = _merged(parents)
        index = index.join(fresh, "ref_id", "left_anti").unionByName(fresh)
        touched = kept.join(fresh.select("ref_id"), "ref_id", "left_semi").drop("kind")
        kept = kept.join(fresh.select("ref_id"), "ref_id", "left_anti").unionByName(_probe(touched, fresh))
    if references is not None:
        new = references.join(state.references.select("tbl", "id", "ref_id"), ["tbl", "id", "ref_id"], "left_anti")
        kept = kept.unionByName(_probe(new, index))
    if stash is not None:
        index, kept = stash.put(index), stash.put(kept)
    return OrphanState(index, kept)


def open_orphans(state: OrphanState) -> DataFrame:
    """Rows (tbl, id, ref_id, kind) of the references that are unsound now."""
    return state.references.where("kind is not null").select("tbl", "id", "ref_id", "kind")


def snapshot(state: OrphanState) -> DataFrame:
    """Counts per table and month of created_at (yyyy-MM, null if unknown): references and each kind of orphan."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "late", "deleted")]
    return state.references.groupBy("tbl", month).agg(F.count("*").alias("n_references"), *kinds)
