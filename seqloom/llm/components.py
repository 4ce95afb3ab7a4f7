"""Connected components of an edge table, by alternating large-star and small-star steps.

A round links the greater end of each edge to the least neighbour of the lesser end, then the neighbours below a node to the
least of them. Both are a grouped minimum and a join, the edges are written to the shared folder after each step, and rounds
go on until the edges are stars around their least nodes, so the result is exact. The minimum is added up in each task first.
Nodes with more than one in ``HEAVY`` of all edges above them are at most ``HEAVY``; the driver gets these with their least
neighbours, which are broadcast to their edges wherever these lie, while the edges of all other nodes are dealt by node. Only a
component's least nodes come to have many edges, and only in the step that looks at the greater neighbours, so that is where
it is done. Besides, the driver gets a sum and a flag a round.

The driver keeps the plan of each job and the figures of each task, so steps are jobs of one join each that read what the one
before wrote, and there is no round for edges that are stars already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


HEAVY = 2048


def _state(edges: DataFrame) -> tuple[bool, list[tuple[int, int | None]]]:
    """Whether all edges are stars around their least nodes, and the nodes with very many greater neighbours, each with its
    least neighbour if that is less than it."""
    limit = max(64, edges.count() // HEAVY)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("m"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("m"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.min("m").alias("m"), F.sum("below").alias("below"), F.sum("above").alias("above"))
    inner = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))
    found = nodes.agg(F.max(inner).alias("open"), F.collect_list(F.when(F.col("above") > limit, F.struct("node", "m"))).alias("heavy")).first()
    return not found["open"], [tuple(r) for r in found["heavy"]]


def _up(edges: DataFrame, heavy: list[tuple[int, int | None]]) -> DataFrame:
    """Links the greater end of each edge to the least neighbour of the lesser end, or to that end if it is less than all."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    rest = edges
    if heavy:
        listed = ", ".join(f"{node}L" for node, _ in heavy)
        rest = edges.where(f"b NOT IN ({listed})")
    linked = rest.join(least.hint("merge"), F.col("b") == F.col("node"), "left")
    if heavy:
        known = edges.sparkSession.createDataFrame(heavy, "node long, m long")
        linked = linked.union(edges.where(f"b IN ({listed})").join(F.broadcast(known), F.col("b") == F.col("node"), "left"))
    # many neighbours below a node become one, so that node's rows don't meet in one task of the next step
    return linked.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _down(edges: DataFrame) -> DataFrame:
    """Links each node and the neighbours below it to the least of these."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    linked = edges.join(least.hint("merge"), F.col("a") == F.col("node"))
    return linked.select(F.explode(F.expr("array(named_struct('a', a, 'b', m), named_struct('a', b, 'b', m))")).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): longs, undirected, repeats and loops allowed. Returns (node, component): the smallest node reachable.

    Only nodes with an edge to another one are returned; an empty table gives an empty table.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    done, heavy = _state(now)
    while not done:
        now = written(_down(written(_up(now, heavy), "raised")), "edges")
        done, heavy = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
