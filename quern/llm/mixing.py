"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import label
from quern.operators.order import running_total
from quern.runtime import Stash

SLOTS = 65_536
MAX_SOURCES = 100_000
"""More target sources are refused; they are a parameter, not data."""


def finish_time(sources: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources (weight, tokens in all passes) have sent the budget together.

    A source sends its weight a unit of time until it runs out; the others then go on, so they make up for it.
    """
    weight, sent, time = sum(w for w, _ in sources), 0.0, 0.0
    for w, supply in sorted(sources, key=lambda x: x[1] / x[0]):
        out = supply / w
        if sent + weight * (out - time) >= budget:
            break
        sent, time, weight = sent + weight * (out - time), out, weight - w
    else:
        return time
    return time + (budget - sent) / weight


def _wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, weight, n_docs, n_tokens) for every target; the weights of usable sources sum to 1."""
    want = targets.groupBy(label("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = want.join(have, "source", "left").na.fill(0, ["n_docs", "n_tokens", "target_share", "max_repeats"])
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    share = F.sum(F.when(usable, F.col("target_share"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("weight", F.when(usable, F.col("target_share") / share))


def exact_budget(sizes: DataFrame, targets: DataFrame) -> int:
    """The largest total at which every source with documents can give its target share within its repeats."""
    rows = _wanted(sizes, targets)
    return math.floor(rows.agg(F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("weight"))).first()[0] or 0)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, int]:
    """(source, target_share, max_repeats, weight, n_docs, n_tokens, passes) for every target, and the budget.

    A source without tokens has weight null; the weights of the others sum to 1. Without ``total_tokens`` the budget
    is what the usable sources hold in all, once.
    """
    rows = _wanted(sizes, targets)
    found = rows.where("weight is not null").select("weight", "n_tokens", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if total_tokens is None:
        total_tokens = sum(r["n_tokens"] for r in found)
    end = finish_time([(r["weight"], r["n_tokens"] * r["max_repeats"]) for r in found], total_tokens)
    need = F.ceil(F.lit(float(end)) * F.col("weight") / F.col("n_tokens")) + 1
    return rows.withColumn("passes", F.least(F.col("max_repeats"), need).cast("int")), total_tokens


def _shuffled(seed: int) -> F.Column:
    """A uniform number of 63 bits for each copy, the same in Spark and SQL."""
    return F.shiftleft(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "copy", "doc_id"), 256), 1, 15), 16, 10).cast("bigint"), 3)


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (source, doc_id, copy, n_tokens, finish), sorted, and its report, one row for each target source.

    sizes: (doc_id, source, n_tokens); targets: (source, target_share, max_repeats). Every copy of a document gets the
    virtual time at which its source has sent it: the source's tokens so far, in shuffled order, over its weight. The
    copies are sorted by that time and cut off where the next would exceed the budget, which is ``total_tokens`` or else
    what the target sources hold in all. A source whose repeats are used up falls short of its share, and the others
    make up for it in proportion to their weights; the report has the shares reached. Up to exact_budget none falls
    short. Documents of other sources, with a null doc_id or without tokens aren't used; a null source is none. All
    copies of a pass come before the next pass.
    report: (source, target_share, reached_share, n_tokens, n_docs, most_copies), with zeros for what isn't there.
    """
    stash = Stash(sizes.sparkSession)
    usable = stash.put(sizes.where("doc_id is not null and source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens"))
    sources, budget = plan(usable, targets, total_tokens)
    sources = stash.put(sources)
    passes = sources.where("passes > 0").select("source", "weight", F.posexplode(F.sequence(F.lit(1), "passes")).alias("at", "copy"), F.col("n_tokens").alias("_all"))
    copies = usable.join(passes, "source").withColumn("_queue", F.concat_ws("\n", "source", "copy")).withColumn("_order", _shuffled(seed))
    timed = running_total(copies, "_queue", "_order", "n_tokens", "doc_id", "_sent")
    time = (F.col("_sent") + F.col("at").cast("bigint") * F.col("_all")) / F.col("weight")
    timed = stash.put(timed.select("source", "doc_id", "copy", "n_tokens", time.alias("finish")).where(F.col("finish").isNotNull()))
    stash.release(usable)
    # the slot of virtual time in which the budget runs out
    width = max(1.0, (timed.agg(F.max("finish")).first()[0] or 0) / SLOTS)
    slot = F.floor(F.col("finish") / F.lit(width))
    so_far = F.sum("n_tokens").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = timed.groupBy(slot.alias("slot")).agg(F.sum("n_tokens").alias("n_tokens")).select("slot", so_far.alias("until"), (so_far - F.col("n_tokens")).alias("before"))
    over = slots.where(F.col("until") > budget).orderBy("slot").limit(1).collect()
    chosen = timed
    if over:
        cut = over[0]
        edge = timed.where(slot == cut["slot"]).withColumn("_run", F.sum("n_tokens").over(Window.orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)))
        chosen = timed.where(slot < cut["slot"]).unionByName(edge.where(F.col("_run") + F.lit(cut["before"]) <= budget).drop("_run"))
    used = chosen.groupBy("source").agg(F.sum("n_tokens").alias("_tokens"), F.countDistinct("doc_id").alias("_docs"), F.max("copy").alias("_copies"))
    everything = F.sum("_tokens").over(Window.partitionBy(F.lit(1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = sources.join(used, "source", "left").select(
        "source",
        "target_share",
        zero(F.round(F.col("_tokens") / everything, 6)).alias("reached_share"),
        zero(F.col("_tokens")).alias("n_tokens"),
        zero(F.col("_docs")).alias("n_docs"),
        zero(F.col("_copies")).alias("most_copies"),
    )
    return chosen.orderBy("finish", "source", "doc_id", "copy").select("source", "doc_id", "copy", "n_tokens", "finish"), report
