"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    moved = both.where("other > node").join(least, "node")
    return _distinct(moved.select(F.col("other").alias("hi"), F.least("node", "least").alias("lo")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return _distinct(moved.union(least.select("hi", F.col("least").alias("lo"))))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node with an edge.

    Large and small stars alternate until nothing moves, a number of rounds that grows
    with the logarithm of the graph.  Minima are partial aggregates; in the joins back
    one side has one row per node, so a node with a third of all edges only makes the
    other side large, which adaptive execution splits.  Each round starts from a
    stored table.  Edges with a null end are ignored; repeated edges count once.
    """
    state = stored(_distinct(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo"))), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        state = stored(_small_star(_large_star(state)), "edges")
    else:
        raise RuntimeError(f"components still move after {most_rounds} rounds")
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        state.select("lo", "lo").distinct()
    )
