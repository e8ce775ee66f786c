"""Splitting labelled questions first and mining each side from its own documents, with a manifest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import mining, ranking, splits
from quern.operators.records import clean_ids, document_ids, question_of, require_disjoint
from quern.runtime import Stash
from quern.sources import schemas

NEGATIVES = ("random", "bm25-hard-negative")
POLICIES = ("document-disjoint", "shared-corpus")
SCOPES = {"train": "train-partition-only", "validation": "validation-partition-only"}


def check_policy(found: dict[str, int], policy: str) -> None:
    """No question or group on both sides, and under document-disjoint no document either."""
    if found["question_overlap"] or found["group_overlap"]:
        raise ValueError(f"the sides share {found['question_overlap']} questions and {found['group_overlap']} groups")
    if policy == "document-disjoint" and found["document_overlap"]:
        raise ValueError(f"the sides share {found['document_overlap']} documents")


def _mined(own: DataFrame, pool: DataFrame, count: int, negatives: str, seed: int) -> DataFrame:
    relevant = own.select(F.col("id").alias("query_id"), F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("doc_id"))
    if negatives == "random":
        return mining.random_negatives(own, pool, relevant, count, seed)
    return ranking.BM25().index(pool).rank(own, count, excluded=relevant)


def build(questions: DataFrame, documents: DataFrame, distractors: int = 2, negatives: str = "random", seed: int = 42) -> DataFrame:
    """Training examples with contexts, mined from all documents."""
    if negatives not in NEGATIVES or distractors < 0:
        raise ValueError("unknown kind or number of negatives")
    mined = Stash(questions.sparkSession).put(_mined(questions, documents, distractors, negatives, seed).select("query_id", "doc_id"))
    return mining.training_examples(questions, documents, mined, seed)


def prepare(
    questions: DataFrame,
    documents: DataFrame,
    ratio: float = 0.1,
    distractors: int = 2,
    strategy: str = "grouped",
    policy: str = "document-disjoint",
    group_by: tuple[str, ...] = (),
    negatives: str = "random",
    pool: int = 20,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """Training and validation examples with contexts, and the manifest.

    questions: (id, question, reference_answer, relevant_doc_ids and the fields of ``group_by``); documents: (id, text,
    pos). Questions are split row by row or grouped with whatever they are tied by; under document-disjoint, documents tie
    questions and each side mines from its own pool, neither of which may be empty; under shared-corpus both mine from all
    documents. ``pool`` is recorded only: the ranking is exact, so more candidates change nothing.
    """
    if strategy not in ("row", "grouped") or policy not in POLICIES or negatives not in NEGATIVES:
        raise ValueError("unknown strategy, policy or kind of negatives")
    stash = Stash(questions.sparkSession)
    disjoint = policy == "document-disjoint"
    if strategy == "row":
        groups = questions.select("id", F.col("id").alias("group"))
    else:
        groups = splits.question_groups(questions, group_by, by_document=disjoint, strict=True)
    assigned = stash.put(splits.split_groups(stash.put(groups), ratio, seed))
    audit = splits.audit(questions, assigned).first().asDict()
    check_policy(audit, policy)
    pools = stash.put(splits.document_pools(documents, assigned, questions, ratio, seed)) if disjoint else None
    total = documents.count()
    sizes = {r["pool"]: r["count"] for r in pools.groupBy("pool").count().collect()} if disjoint else {"train": total, "validation": total, "both": total}
    wanted = ("train", "validation") if ratio > 0 else ("train",)
    if any(not sizes.get(side) for side in wanted):
        raise ValueError(f"a side has no documents to mine from: {sizes}")
    sides = {}
    for side in ("train", "validation"):
        own = questions.join(assigned.where(F.col("split") == side).select("id"), "id", "left_semi")
        texts = documents if pools is None else documents.join(pools.where(F.col("pool") == side).select(F.col("doc_id").alias("id")), "id", "left_semi")
        mined = stash.put(_mined(own, texts, distractors, negatives, seed).select("query_id", "doc_id"))
        sides[side] = stash.put(mining.training_examples(own, texts, mined, seed).withColumn("mining_scope", F.lit(SCOPES[side] if disjoint else "global")))
    counted = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.count_distinct("group").alias("n")).collect()}
    manifest = {
        "schema_name": "raft-partition-manifest",
        "schema_version": 1,
        "strategy": strategy,
        "group_by": ["normalized_question", *group_by] if strategy == "grouped" else [],
        "group_counts": {side: counted.get(side, 0) for side in sides},
        "corpus_policy": policy,
        "partition_fingerprints": {side: splits.table_fingerprint(splits.source_fingerprints(frame, "answer")).first()["fingerprint"] for side, frame in sides.items()},
        "document_overlap_count": audit["document_overlap"],
        "question_overlap_count": audit["question_overlap"],
        "negative_mining_scope": "split-before-mining",
        "negative_strategy": negatives,
        "candidate_pool_size": pool,
        "distractors": distractors,
        "document_pools": {"train_count": sizes.get("train", 0), "validation_count": sizes.get("validation", 0), "overlap_count": sizes.get("both", 0)},
        "seed": seed,
        "ratio": ratio,
        "rows": {side: frame.count() for side, frame in sides.items()},
    }
    schemas.require(manifest, schemas.PARTITIONS)
    return sides["train"], sides["validation"], manifest


def given_splits(train: DataFrame, validation: DataFrame, held_out: DataFrame | None = None, policy: str = "shared-corpus", group_by: tuple[str, ...] = ()) -> dict[str, Any]:
    """Check training and validation rows that were split elsewhere, and what is held out; the audit and the scope of mining.

    Rows may be of any form. No two of the three may share an id or a question; the policy holds as in ``prepare``.
    """
    for name, rows in (("training data", train), ("validation data", validation)):
        if rows.limit(1).count() == 0:
            raise ValueError(f"there is no {name}")
    pairs = [(train, validation, ("training data", "validation data"))]
    if held_out is not None:
        pairs += [(train, held_out, ("training data", "held-out evaluation")), (validation, held_out, ("validation data", "held-out evaluation"))]
    for one, other, names in pairs:
        require_disjoint(one, other, names)
    shape = lambda rows, side: rows.select("id", question_of(rows).alias("question"), document_ids(rows).alias("relevant_doc_ids"), F.lit(side).alias("split"), *([F.struct(*{f.split(".")[0] for f in group_by}).alias("given")] if group_by else []))
    both = Stash(train.sparkSession).put(shape(train, "train").unionByName(shape(validation, "validation")))
    groups = splits.question_groups(both, tuple(f"given.{f}" for f in group_by), by_document=policy == "document-disjoint")
    audit = splits.audit(both.drop("split"), groups.join(both.select("id", "split"), "id")).first().asDict()
    check_policy(audit, policy)
    scopes = sorted({r[0] for rows in (train, validation) if "mining_scope" in rows.columns for r in rows.select("mining_scope").where("mining_scope is not null").distinct().limit(10).collect()})
    scope = "split-before-mining" if set(SCOPES.values()) <= set(scopes) else ",".join(scopes) or "not-applicable"
    return {"audit": audit, "negative_mining_scope": scope}
