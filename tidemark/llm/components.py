"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Up to so many edges the neighbours of a node, of which there are no more, are gathered in a row.
FEW = 100_000
#: Tasks of a step over so few edges; steps over more have as many as the session's shuffles.
TASKS = 8


def components(edges: DataFrame, broadcast: int = FEW) -> DataFrame:
    """(node, root) for every node of edges (u long, v long) but the roots; a root is the least node of its component.

    Up to `broadcast` edges, a step gathers each node's neighbours, map-side first, and goes through few tasks, as it would
    start hundreds for each shuffle. It joins nothing: the driver keeps the plans of its last thousand queries, which fill
    its memory where they are large. Steps over more edges join them to one minimum per node, which is written first, so that
    both sides are shuffled and Spark splits a node with very many neighbours. The steps end when each node has one edge to a
    node that has none to a lesser one. Edges never reach the driver. Self loops, repeated edges and empty input are fine.
    """
    at, few = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), False
    while True:
        n, unsettled = _state(at, few)
        few = n <= broadcast
        if not unsettled:
            return (at.coalesce(TASKS) if few else at).select(F.col("u").alias("node"), F.col("v").alias("root"))
        at = cut(_gathered(at) if few else _joined(at))


def _gathered(at: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star step over rows of neighbours."""
    at = at.coalesce(TASKS)
    both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.collect_set("v").alias("vs")).coalesce(TASKS)
    large = rows.select(F.explode(F.filter("vs", lambda v: v > F.col("u"))).alias("u"), F.col("m").alias("v"))
    rows = large.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs")).coalesce(TASKS)
    small = rows.select(F.explode(F.concat(F.array("u"), F.filter("vs", lambda v: v != F.col("m")))).alias("u"), F.col("m").alias("v"))
    return small.distinct().coalesce(TASKS)


def _joined(at: DataFrame) -> DataFrame:
    """The same by joins with the minima."""
    both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(cut(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(cut(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(at: DataFrame, few: bool) -> tuple[int, bool]:
    """How many edges (u > v) there are, and whether a node has several lesser neighbours, or one that has a lesser one, too."""
    at = at.coalesce(TASKS) if few else at
    ends = at.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(at.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    nodes = nodes.coalesce(TASKS) if few else nodes
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.coalesce(F.max(F.expr("down > 1 or (down > 0 and n > down)")), F.lit(False))).head())
