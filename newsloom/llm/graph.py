"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """Of every vertex u: an edge from each neighbour above its least neighbour m to m, and from u."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(v, root) for every vertex of an edge that is not alone; root is the least vertex reachable.

    Each round is two aggregations joined back to the edges, so no neighbourhood is gathered in one
    row and Spark may split the join of a vertex with many edges. Lineage is cut every round.
    Null ends and loops are dropped; repeated edges count once. An empty table gives no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND u <> v")
    e = cut(e.distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _stars(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
