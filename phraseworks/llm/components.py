"""Connected components over an edge table, by alternating star steps with a checkpoint per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseworks.session import cut_lineage

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: each directed edge with the least node of u's closed neighbourhood; minima are pre-aggregated, nothing is gathered."""
    m = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(m, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of undirected ``edges (u, v)``; root is the component's least node.

    Large-star: neighbours above a node are linked to its least neighbour. Small-star: neighbours below it, and itself. The
    edge set never grows; rounds are logarithmic in the longest path. Nodes without an edge are not listed.
    """
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut_lineage(linked)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, now = tuple(state), after
    else:
        raise RuntimeError("components did not settle")
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
