"""Records in their validated form: cleaned references, single deliveries, and rule violations as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import question_key

BLANKS = " \t\r\n"


def deliveries_once(records: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id; repeated deliveries are equal in content, so any will do. Rows without id are left out."""
    return records.where(F.col(key).isNotNull()).dropDuplicates([key])


def clean_ids(ids: Column) -> Column:
    """Ids without blanks around, in their order, without null, blank and repeated ones; empty for null."""
    trimmed = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x, F.lit(BLANKS)))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def merged_evidence(ids: Column, evidence: Column) -> Column:
    """The relevant ids followed by those of the evidence, each once."""
    extra = F.transform(F.coalesce(evidence, F.array().cast("array<struct<doc_id:string,text:string>>")), lambda e: e["doc_id"])
    return F.array_distinct(F.concat(clean_ids(ids), clean_ids(extra)))


def violations(records: DataFrame, rules: Mapping[str, Column], key: str = "id") -> DataFrame:
    """Rows (id, rule) for every rule that a record breaks; a rule holds where its column is true."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return records.select(F.col(key).alias("id"), F.explode(broken).alias("rule"))


def document_rules() -> dict[str, Column]:
    return {"blank_id": F.trim("id", F.lit(BLANKS)) != "", "blank_text": F.trim("text", F.lit(BLANKS)) != ""}


def question_rules() -> dict[str, Column]:
    return {"blank_id": F.trim("id", F.lit(BLANKS)) != "", "empty_question": F.length("question") >= 1}


def repeated_ids(records: DataFrame, key: str = "id") -> DataFrame:
    """Rows (id, n) of the ids that occur more than once."""
    return records.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (ref_id, n_records) of the relevant ids that aren't in the corpus."""
    refs = records.select("id", F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("ref_id")).groupBy("ref_id").agg(F.count("*").alias("n_records"))
    return refs.join(documents.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")


def split_conflicts(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (kind, value, n_one, n_other): ids and questions, in their folded form, that both splits have."""

    def counts(records: DataFrame, n: str) -> DataFrame:
        ids = records.select(F.lit("id").alias("kind"), F.col("id").alias("value"))
        keys = records.select(F.lit("question").alias("kind"), question_key(F.col("question")).alias("value")).where("value <> ''")
        return ids.unionByName(keys).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias(n))

    return counts(one, "n_one").join(counts(other, "n_other"), ["kind", "value"])


def question_of(rows: DataFrame) -> Column:
    """A row's question: ``question``, or ``input`` where there is no such column, or an empty text."""
    return next((F.coalesce(F.col(c), F.lit("")) for c in ("question", "input") if c in rows.columns), F.lit(""))


def document_ids(rows: DataFrame, every: bool = False) -> Column:
    """The documents that a row rests on, from whatever it has: relevant ids, evidence and relevant contexts; ``every`` takes all contexts."""
    ids = F.array().cast("array<string>")
    listed = [F.coalesce(F.col(c), ids) for c in ("relevant_doc_ids", "evidence_doc_ids") if c in rows.columns]
    if "evidence" in rows.columns:
        listed.append(F.coalesce(F.transform("evidence", lambda e: e["doc_id"]), ids))
    if "contexts" in rows.columns:
        kept = F.col("contexts") if every else F.filter("contexts", lambda c: F.coalesce(c["relevant"], F.lit(False)))
        listed.append(F.coalesce(F.transform(kept, lambda c: c["doc_id"]), ids))
    return clean_ids(F.concat(*listed)) if listed else ids


def training_conflicts(one: DataFrame, other: DataFrame) -> DataFrame:
    """split_conflicts of training rows in any form: questions may stand in ``input``; empty ids and questions conflict with none."""
    shape = lambda rows: rows.select(F.when(F.trim("id", F.lit(BLANKS)) != "", F.trim("id", F.lit(BLANKS))).alias("id"), question_of(rows).alias("question"))
    return split_conflicts(shape(one), shape(other))


def require_disjoint(one: DataFrame, other: DataFrame, names: tuple[str, str], shown: int = 10) -> None:
    """Raise an error that shows the first ids and questions that both have."""
    found = training_conflicts(one, other).orderBy("kind", "value").limit(shown).collect()
    if found:
        raise ValueError(f"{names[0]} overlaps {names[1]}: " + "; ".join(f"{r['kind']} {r['value']}" for r in found))


RAFT_RULES = ("no contexts", "no evidence", "repeated contexts", "repeated evidence", "evidence not in contexts", "relevant contexts not in evidence", "evidence marked irrelevant", "nothing relevant", "evidence differs from relevant contexts")


def raft_problems(contexts: Column, evidence: Column) -> Column:
    """The broken rules of a training example with contexts (doc_id, text, relevant) and evidence ids, in fixed order."""
    ids = F.transform(contexts, lambda c: c["doc_id"])
    pick = lambda flag: F.transform(F.filter(contexts, lambda c: F.coalesce(c["relevant"], F.lit(False)) == flag), lambda c: c["doc_id"])
    relevant, others = pick(F.lit(True)), pick(F.lit(False))
    repeated = lambda a: F.size(a) > F.size(F.array_distinct(a))
    some = lambda a: F.size(a) > 0
    same = (F.size(F.array_except(evidence, relevant)) == 0) & (F.size(F.array_except(relevant, evidence)) == 0)
    bad = (
        F.size(contexts) == 0,
        F.size(evidence) == 0,
        repeated(ids),
        repeated(evidence),
        some(F.array_except(evidence, ids)),
        some(F.array_except(relevant, evidence)),
        some(F.array_intersect(evidence, others)),
        F.size(relevant) == 0,
        ~same,
    )
    return F.array_compact(F.array(*(F.when(b, F.lit(name)) for b, name in zip(bad, RAFT_RULES))))
