"""Splitting records into training and validation parts, and auditing such splits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import question_key
from quern.operators.components import connected_components
from quern.operators.order import running_total
from quern.operators.records import clean_ids
from quern.runtime import Stash, join_unique


def _order(seed: int, key: Column) -> Column:
    """A uniform number of 63 bits, not negative, so that it orders the same in Spark, SQL and Python."""
    return F.shiftleft(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 1, 15), 16, 10).cast("bigint"), 3)


def target_rows(n: int, ratio: float, groups: int) -> int:
    """How many rows go to validation: the ratio rounded half to even, at least one. 0 if the ratio is 0."""
    if not 0 <= ratio < 1:
        raise ValueError("the ratio must be at least 0 and less than 1")
    if ratio == 0:
        return 0
    if n < 2 or groups < 2:
        raise ValueError("a split needs at least two rows and two groups")
    return max(1, round(n * ratio))


def _field(records: DataFrame, name: str) -> Column:
    """The values of a dotted field as a list of texts; within a text column, the path is looked up as JSON. A missing one is refused."""
    root, _, inside = name.partition(".")
    kind = records.schema[root].dataType.typeName() if root in records.columns else None
    if kind == "string" and inside:
        found = F.get_json_object(root, f"$.{inside}")
        return F.coalesce(F.from_json(found, "array<string>"), F.array(found))
    try:
        return (F.col(name) if records.select(name).schema[0].dataType.typeName() == "array" else F.array(F.col(name))).cast("array<string>")
    except AnalysisException as error:
        raise ValueError(f"records have no field {name}") from error


def ungrouped(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, field) of the records that a field doesn't group: it is null, an empty list, or has a null or empty value."""
    bad = lambda v: v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | (x == ""))
    marked = F.array_compact(F.array(*(F.when(bad(_field(records, f)), F.lit(f)) for f in fields)))
    return records.select("id", F.explode(marked).alias("field"))


def question_groups(records: DataFrame, fields: tuple[str, ...] = (), by_document: bool = False, strict: bool = False) -> DataFrame:
    """(id, group): the records tied by question, by the values of the fields, and, if asked, by relevant documents.

    Questions are compared in their folded form; a field may be dotted and hold a value or a list of values. A field that
    the records don't have is refused; null and empty values tie nothing or, if ``strict``, are refused too. The group is
    its least id.
    """
    stash = Stash(records.sparkSession)
    if strict and fields:
        without = ungrouped(records, fields).orderBy("id", "field").limit(10).collect()
        if without:
            raise ValueError("records without a value to group by: " + "; ".join(f"{r['id']}: {r['field']}" for r in without))
    keys = [F.when(question_key(F.col("question")) != "", F.concat(F.lit("question="), question_key(F.col("question"))))]
    values = {f: _field(records, f) for f in fields}
    tag = lambda f, v: F.transform(F.filter(v, lambda x: x != ""), lambda x: F.concat(F.lit(f"{f}="), x))
    named = [tag(f, v) for f, v in values.items()]
    listed = F.transform(clean_ids(F.col("relevant_doc_ids")), lambda x: F.concat(F.lit("document="), x)) if by_document else F.array().cast("array<string>")
    tokens = records.select("id", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*keys)), listed, *(F.coalesce(n, F.array().cast("array<string>")) for n in named)))).alias("token"))
    tokens = stash.put(tokens.select("id", F.sha2("token", 256).alias("token")))
    least = stash.put(tokens.groupBy("token").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")))
    total = least.agg(F.sum("n_rows")).first()[0] or 0
    ties = join_unique(tokens, least, "token", total).where("id <> least").select("id", "least").distinct()
    parts = connected_components(ties, "id", "least").select(F.col("node").alias("id"), "component")
    return records.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("group"))


def split_groups(groups: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(id, group, split): whole groups go to validation, in the order of their hashes, until the target is reached.

    A group is taken if the rows taken before it are fewer than the target; one group always stays in train.
    """
    stash = Stash(groups.sparkSession)
    sizes = stash.put(groups.groupBy("group").agg(F.count("*").alias("size"), F.count("*").alias("n_rows")))
    total = sizes.agg(F.sum("size").alias("n"), F.count("*").alias("g")).first()
    target = target_rows(total["n"] or 0, ratio, total["g"])
    ordered = sizes.select("group", "size", "n_rows", F.lit("all").alias("g"), F.lit(1).alias("one"), _order(seed, F.col("group")).alias("h"))
    summed = running_total(running_total(ordered, "g", "h", "size", "group", "upto"), "g", "h", "one", "group", "nth")
    taken = (F.col("upto") - F.col("size") < target) & (F.col("nth") < total["g"])
    named = stash.put(summed.select("group", "n_rows", F.when(taken, "validation").otherwise("train").alias("split")))
    return join_unique(groups, named, "group", total["n"] or 0).select("id", "group", "split")


def split_rows(records: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(id, group, split) with every record as its own group."""
    return split_groups(records.select("id", F.col("id").alias("group")), ratio, seed)


def document_pools(documents: DataFrame, assigned: DataFrame, records: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """(doc_id, pool): disjoint pools; relevant documents go with their records, the others by hash in the ratio.

    A document that both sides refer to is a conflict, with the pool "both".
    """
    sides = records.select("id", F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("doc_id")).join(assigned.select("id", "split"), "id")
    used = sides.groupBy("doc_id").agg(F.when(F.min("split") == F.max("split"), F.min("split")).otherwise("both").alias("pool"))
    ids = documents.select(F.col("id").alias("doc_id"))
    neutral = Stash(documents.sparkSession).put(ids.join(used, "doc_id", "left_anti"))
    target = round(neutral.count() * ratio)
    placed = running_total(neutral.select("doc_id", F.lit("all").alias("g"), F.lit(1).alias("one"), _order(seed, F.col("doc_id")).alias("h")), "g", "h", "one", "doc_id", "nth")
    rest = placed.select("doc_id", F.when(F.col("nth") <= target, "validation").otherwise("train").alias("pool"))
    return ids.join(used, "doc_id").unionByName(rest)


def audit(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: rows and groups of each side, and how many groups, questions and relevant documents both sides share."""
    rows = records.select("id", question_key(F.col("question")).alias("q"), clean_ids(F.col("relevant_doc_ids")).alias("refs")).join(assigned, "id")

    def shared(values: DataFrame, name: str) -> DataFrame:
        sides = values.where("v is not null and v <> ''").groupBy("v").agg(F.count_distinct("split").alias("n"))
        return sides.agg(F.count_if(F.col("n") > 1).alias(name))

    sizes = assigned.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_distinct("group").alias("groups"),
    )
    parts = (
        shared(assigned.select(F.col("group").alias("v"), "split"), "group_overlap"),
        shared(rows.select(F.col("q").alias("v"), "split"), "question_overlap"),
        shared(rows.select(F.explode("refs").alias("v"), "split"), "document_overlap"),
    )
    for part in parts:
        sizes = sizes.crossJoin(part)  # one row each
    return sizes


def source_fingerprints(records: DataFrame, answer: str) -> DataFrame:
    """(id, fingerprint) of (id, folded question, answer): equal for whatever form a record is kept in."""
    parts = F.concat_ws("\x1f", "id", F.coalesce(question_key(F.col("question")), F.lit("")), F.coalesce(F.col(answer), F.lit("")))
    return records.select("id", F.sha2(parts, 256).alias("fingerprint"))


def row_fingerprints(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, fingerprint) over all of a row's fields, as JSON with sorted keys; null fields count, their order doesn't."""
    import hashlib
    import json

    import pyarrow as pa

    kind, names = rows.schema[key].dataType.simpleString(), sorted(rows.columns)

    def canonical(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            prints = [hashlib.sha256(json.dumps(dict(zip(names, values)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest() for values in zip(*columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(prints, pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(canonical, f"id {kind}, fingerprint string")


LEVELS = (12, 9, 6, 3, 0)
"""How many hexadecimal digits of a row's fingerprint name its block, level by level."""


def table_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """One row (fingerprint, n): of the rows' fingerprints whatever their order, taken by blocks so no task holds all.

    A block's fingerprint is that of the sorted fingerprints in it; blocks of 12 digits hold rows, the others at most 4,096
    blocks of the level below, and the last all of those.
    """
    rows = fingerprints.select(F.col("fingerprint").alias("name"), F.col("fingerprint").alias("f"), F.lit(1).cast("bigint").alias("n"))
    for digits in LEVELS:
        joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("name", "f"))), lambda x: x["f"]))
        blocks = rows.groupBy(F.substring("name", 1, digits).alias("name")) if digits else rows
        rows = blocks.agg(F.sha2(joined, 256).alias("f"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return rows.select(F.col("f").alias("fingerprint"), "n")
