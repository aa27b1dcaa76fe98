"""Connected components by alternating large and small stars.

Every round is two group-wise minima and joins, written to a stage table, so
no component is gathered anywhere; the number of rounds grows with the
logarithm of the number of nodes. Joins against a node with very many edges are
left to AQE's skew splitting; the minima aggregate before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import drop_stage, stage


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: n, m and whether n is the greater (up 1, else down 1)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = F.array(F.struct(F.col("hi").alias("n"), F.col("lo").alias("m"), one.alias("up"), none.alias("down")),
                   F.struct(F.col("lo").alias("n"), F.col("hi").alias("m"), none.alias("up"), one.alias("down")))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre, smaller than all its neighbours, or has one
    neighbour, a smaller one. One aggregate over the nodes, which spares a round that changes nothing."""
    nodes = _ends(edges).groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    least = _ends(edges).groupBy("n").agg(F.min("m").alias("least")).select(F.col("n").alias("lo"), F.least("n", "least").alias("least"))
    large = edges.join(least, "lo").select("hi", F.col("least").alias("lo"))
    root = large.groupBy("hi").agg(F.min("lo").alias("root"))
    small = F.array(F.struct("hi", F.col("root").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")))
    return large.join(root, "hi").select(F.explode(small).alias("e")).select("e.*").where("hi > lo").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (two bigint columns, any order,
    repeats allowed), component being the smallest id reachable."""
    a, b = edges.columns
    now = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                .distinct(), "edges")
    while not _are_stars(now):
        then = now
        now = stage(_round(then), "stars")
        drop_stage(then)
    return (now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
            .union(now.select("lo", "lo").distinct()))
