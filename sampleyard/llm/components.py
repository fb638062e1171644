"""Connected components of an edge table by alternating star contraction, on DataFrames only.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") replace each node's neighbours by the least of them.  The least neighbour comes from an
ordinary ``min`` aggregate (combined before the shuffle, so a hub costs no more than any node);
it is joined back to a hub's edges where they lie, as the hubs are few.  Each round is written to
the shared folder; nothing is collected but one row of counts, observed as the round is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_totals, written, written_with


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m, the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_totals(edges, least, "u", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` have u > v."""
    moved = _with_least(edges, 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("v"))
    return moved.union(least).where("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: component is the least node reachable.

    ``a`` and ``b`` are of one orderable type; self-loops, repeats, both directions and nulls are
    allowed (rows with a null are ignored, a node that has only a self-loop is not returned).  An
    empty table gives an empty table.  Raises if ``max_rounds`` rounds (far above the
    logarithmic number needed) do not reach the fixed point.
    """
    counts = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    now, found = written_with(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", *counts
    )
    before = None
    for _ in range(max_rounds):
        if before == found or not found["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = found
        large = written(_large_star(now, found["n"]).distinct(), "large-star")
        nxt, found = written_with(_small_star(large, found["n"]).distinct(), "small-star", *counts)
        drop_table(large)
        drop_table(now)
        now = nxt
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
