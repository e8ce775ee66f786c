"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import Stash, join_unique


def _stats(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
    least = least.select("a", F.least("a", "m").alias("m"), "n_rows")
    up = both.where(F.col("b") > F.col("a"))
    return join_unique(up, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its lower neighbours are tied to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
    lower = join_unique(down, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of the undirected edges; the component is its least node.

    Nodes may be of any orderable type. Edges with a null end are left out and self-loops keep their node; repeated
    edges change nothing; no edges give no rows. Each round writes its edges to the shared folder. The rounds needed
    grow with the logarithm of the nodes; ``max_rounds`` only guards against an endless run and raises.
    """
    stash = Stash(edges.sparkSession)
    start = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    start = stash.put(start.distinct())
    current = start.where("a <> b")
    was = _stats(current)
    if was[0] == 0:
        return start.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    for _ in range(max_rounds):
        large = stash.put(_large_star(current, 2 * was[0]).where("a <> b").distinct())
        small = stash.put(_small_star(large, was[0]).where("a <> b").distinct())
        stash.release(large)
        stash.release(current)
        current, now = small, _stats(small)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    loops = start.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
