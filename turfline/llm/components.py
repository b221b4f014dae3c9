"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.common import cut, forget

_ROWS = 100_000  # edges that a task takes


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node hands the least of itself and its neighbours to its larger (or else smaller) neighbours and itself."""
    near = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
    handed = near.join(least, "a").coalesce(tasks)
    if large:
        out = handed.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = handed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks)
    return out.where("a != b").distinct().coalesce(tasks)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) pairs of node ids -> (node, component) with the component's least node, for each node that has an edge.

    Only edges move, by node, in shuffles whose aggregates are combined before; a node with many edges is a skewed
    join that AQE splits. As many tasks write a shuffle as the edges need, so that few edges don't leave many files.
    Stops when a round changes no edge; rounds grow as the logarithm of the longest path. most: files of the first checkpoint at most.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), most)
    tasks = 1 + edges.count() // _ROWS
    sums = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while True:
        now = tuple(edges.select(*sums).first())
        if now == before or not now[0]:
            break
        before = now
        edges, done = cut(_star(_star(edges, True, tasks), False, tasks)), edges
        forget(done)
    # each edge now goes from a node to its component's least node
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).unionByName(
        edges.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct().coalesce(tasks)
    )
