"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so a node with very many neighbours is never
gathered in one place; each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets linked to the least of the node and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get linked to the least of them (edges point to smaller ids)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the least node of its component for every node of ``edges`` (roots included)."""
    lo, hi = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    e = materialize(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct())
    before = None
    while True:
        e = materialize(_small_star(_large_star(e).distinct()).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
