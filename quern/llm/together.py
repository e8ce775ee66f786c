"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.runtime import Stash, join_unique

BLANKS = " \t\r\n"
NO_AUTHOR = "unknown"
MAX_SPLITS = 1000
"""More splits are refused; they are a parameter, not data."""


def record_keys(records: DataFrame) -> DataFrame:
    """Rows (id, key): the author, question and referred documents of each record, in their normal form.

    Authors ignore case and blanks around (null, blank and "unknown" are none); questions are lower-cased with runs of
    blanks as one space; entries of relevant_doc_ids are trimmed, null and blank ones are none. Null ids are left out.
    """
    author = F.lower(F.trim(F.col("metadata.author"), F.lit(BLANKS)))
    question = F.trim(F.regexp_replace(F.lower("question"), "[ \t\r\n]+", " "))
    refs = F.transform(F.coalesce("relevant_doc_ids", F.array().cast("array<string>")), lambda x: F.trim(x, F.lit(BLANKS)))
    keys = F.concat(
        F.array(F.when((author != "") & (author != NO_AUTHOR), F.concat(F.lit("a:"), author))),
        F.array(F.when(question != "", F.concat(F.lit("q:"), question))),
        F.transform(F.filter(refs, lambda x: x != ""), lambda x: F.concat(F.lit("d:"), x)),
    )
    rows = records.where("id is not null").select("id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    return rows.select("id", F.sha2("key", 256).alias("key")).distinct()


def tied_groups(records: DataFrame) -> DataFrame:
    """Rows (id, group_id, n_records) for every distinct id; group_id is the least id of the records it is tied to.

    Each key ties its records to the least of them, which is an aggregate and a join whose hot keys are broadcast
    rather than gathered; the ties are closed by connected components. A record without keys is its own group.
    """
    stash = Stash(records.sparkSession)
    keys = stash.put(record_keys(records))
    least = stash.put(keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")).where("n_rows > 1"))
    total = least.agg(F.sum("n_rows")).first()[0] or 0
    ties = join_unique(keys, least, "key", total).where("id <> least").select("id", "least").distinct()
    parts = stash.put(connected_components(ties, "id", "least"))
    ids = records.select("id").where("id is not null").distinct()
    rows = ids.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))
    sizes = stash.put(rows.groupBy("group_id").agg(F.count("*").alias("n_records"), F.count("*").alias("n_rows")))
    n = sizes.agg(F.sum("n_rows")).first()[0] or 0
    return join_unique(rows, sizes, "group_id", n).select("id", "group_id", "n_records")


def split_ranges(shares: DataFrame) -> DataFrame:
    """(split, low, high): the targets as consecutive parts of 0 to 1, in the order of their names."""
    total = F.sum("share").over(Window.partitionBy(F.lit(1)))
    high = F.sum("share").over(Window.orderBy("split")) / total
    return shares.where("share > 0").select("split", high.alias("high"), (high - F.col("share") / total).alias("low"))


def assign_splits(groups: DataFrame, shares: DataFrame, seed: int = 42) -> DataFrame:
    """Rows (id, group_id, split): a group goes to the split in whose range its hash falls.

    shares: (split, share), of at most MAX_SPLITS rows with a share; more are refused. Related records never part; the proportions hold over groups, so a group
    that holds a large part of all records moves them by as much, which split_report shows.
    """
    point = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "group_id"), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    ranges = [(r["split"], r["high"]) for r in split_ranges(shares).orderBy("high").limit(MAX_SPLITS + 1).collect()]
    if not ranges or len(ranges) > MAX_SPLITS:
        raise ValueError(f"splits with a share must number 1 to {MAX_SPLITS}")
    split = F.lit(ranges[-1][0])
    for name, high in reversed(ranges[:-1]):
        split = F.when(point < high, name).otherwise(split)
    return groups.select("id", "group_id", split.alias("split"))


def split_report(assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """(split, share, n_records, n_groups, reached_share) of every split."""
    got = assigned.groupBy("split").agg(F.count("*").alias("n_records"), F.countDistinct("group_id").alias("n_groups"))
    total = F.sum("n_records").over(Window.partitionBy(F.lit(1)))
    rows = shares.join(got, "split", "left").na.fill(0, ["n_records", "n_groups"])
    return rows.select("split", "share", "n_records", "n_groups", F.round(F.col("n_records") / total, 6).alias("reached_share"))
