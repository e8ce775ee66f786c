"""Filling containers of a fixed capacity by hierarchical residual packing."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import Stash

FAN_IN = 8
MEMBERS = "array<struct<doc_id:bigint,part:int,n_parts:int,n_tokens:int>>"
FIELDS = ("doc_id", "part", "n_parts", "n_tokens")
BINS = f"src int, done boolean, fill int, members {MEMBERS}"


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing: items are (size, index); returns (fill, indexes) of each bin. Ties go by index."""
    bins: list[tuple[int, list[int]]] = []
    gaps: list[tuple[int, int]] = []  # (free space, bin), sorted
    for size, index in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
            bins[b][1].append(index)
            bins[b] = (bins[b][0] + size, bins[b][1])
        else:
            gap, b = capacity, len(bins)
            bins.append((size, [index]))
        if gap - size:
            insort(gaps, (gap - size, b))
    return bins


def divide(sizes: DataFrame, capacity: int) -> DataFrame:
    """Rows (doc_id, part, n_parts, n_tokens): a document larger than the capacity in full parts and a rest, any other whole."""
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
    rows = sizes.where("doc_id is not null").select("doc_id", n.alias("n"), parts.alias("n_parts"))
    rows = rows.select("doc_id", "n", "n_parts", F.posexplode(F.sequence(F.lit(1), "n_parts")).alias("at", "part"))
    return rows.select("doc_id", "part", "n_parts", F.least(F.lit(capacity), F.col("n") - F.col("at") * F.lit(capacity)).cast("int").alias("n_tokens"))


def _bins(src: int, groups: list[tuple[int, list[dict]]], capacity: int, limit: float) -> pa.RecordBatch:
    """Best-fit bins of the groups (fill, members); those below the limit stay open."""
    made = [(fill, [m for i in index for m in groups[i][1]]) for fill, index in best_fit([(g[0], i) for i, g in enumerate(groups)], capacity)]
    rows = [{"src": src, "done": fill >= limit, "fill": fill, "members": members} for fill, members in made]
    member = pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("n_parts", pa.int32()), ("n_tokens", pa.int32())])
    schema = pa.schema([("src", pa.int32()), ("done", pa.bool_()), ("fill", pa.int32()), ("members", pa.list_(member))])
    return pa.RecordBatch.from_pylist(rows, schema)


def pack(sizes: DataFrame, capacity: int = 1024, nearly_full: float = 0.98, room: int = 16_384) -> DataFrame:
    """Rows (container, doc_id, part, n_parts, n_tokens): every document in containers of at most ``capacity`` tokens.

    sizes: (doc_id, n_tokens), doc_id unique. Each partition packs its own items best-fit, 100,000 at a time, and closes
    the nearly full bins. The underfull ones are the items of further best-fit rounds up a tree: each round packs them
    in a FAN_IN-th of the groups, but in no fewer than keep a group at about ``room`` bins, so that no task grows with
    the data. The rounds end with a single group, or when groups of that size close or join less than a hundredth of the
    open bins; every open bin takes part in every round. Only a document larger than the capacity is divided. Sizes of
    null or 0 take no room but have a container. Rows without doc_id are left out; an empty table gives none. The
    container is named by its least member. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    stash = Stash(sizes.sparkSession)
    limit = nearly_full * capacity

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def closed() -> Iterator[pa.RecordBatch]:
            out = _bins(TaskContext.get().partitionId(), [(m["n_tokens"], [m]) for m in items], capacity, limit)
            for at in range(0, len(out), 20_000):
                yield out.slice(at, 20_000)

        items: list[dict] = []
        for batch in batches:
            items += batch.select(list(FIELDS)).to_pylist()
            if len(items) >= 100_000:
                yield from closed()
                items = []
        yield from closed()

    def merge(key: tuple, bins: pa.Table) -> pa.Table:
        groups = [(r["fill"], r["members"]) for r in bins.select(["fill", "members"]).to_pylist()]
        groups.sort(key=lambda g: (g[0], g[1][0]["doc_id"], g[1][0]["part"]))
        return pa.Table.from_batches([_bins(key[0].as_py(), groups, capacity, limit)])

    level = stash.put(divide(sizes, capacity).mapInArrow(local, BINS))
    rows = level.where("done")
    state = level.where("not done").agg(F.count("*"), F.max("src")).first()
    n_open, groups = state[0], (state[1] or 0) + 1
    while n_open and groups > 1:
        before, groups = (n_open, groups), max(math.ceil(n_open / room), math.ceil(groups / FAN_IN))
        first = F.col("members")[0]
        group = F.pmod(F.xxhash64(first["doc_id"], first["part"], F.lit(before[1])), F.lit(groups)).cast("int")
        level = stash.put(level.where("not done").select(group.alias("src"), "fill", "members").groupBy("src").applyInArrow(merge, BINS))
        rows = rows.unionByName(level.where("done"))
        n_open = level.where("not done").count()
        if groups >= before[1] and n_open > 0.99 * before[0]:
            break
    rows = rows.unionByName(level.where("not done"))
    least = F.array_min(F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["part"].alias("part"))))
    name = F.concat_ws("-", least["doc_id"], least["part"]).alias("container")
    return rows.select(name, F.explode("members").alias("m")).select("container", *(F.col(f"m.{f}") for f in FIELDS))


def divided(packed: DataFrame) -> DataFrame:
    """Rows (doc_id) of the documents that were divided because they exceed a container."""
    return packed.where("n_parts > 1").select("doc_id").distinct()


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: containers, tokens, the share of the room that is used, and the least number of containers possible."""
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    total = F.sum("fill")
    return bins.agg(F.count("*").alias("n_containers"), total.alias("n_tokens"), F.round(total / (F.count("*") * capacity), 6).alias("used_share"), F.ceil(total / capacity).alias("least_containers"))
