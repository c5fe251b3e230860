"""Connected components of an undirected graph by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond").

Every step is an aggregate and a join on node ids. Edges are stored between rounds, so lineage stays
short; nothing but whether all is done reaches the driver. Hub nodes only ever meet one-row
sides in joins, which AQE splits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallkeeper.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = _lowest(edges)
    rest = (edges.join(low, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return rest.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return seen.where("out > 1 OR (out = 1 AND root = 1)").limit(1).count() == 0


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node id
    reachable. Self loops, repeated and reversed edges and null ends are allowed (ignored). ``rows``: an upper
    bound of the number of edges, if it is known."""
    edges = stored(edges.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows)
    rows = edges.count()  # no round makes more
    for _ in range(max_rounds):
        if _stars(edges):
            break
        edges = stored(_small_star(_large_star(edges)), rows)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
