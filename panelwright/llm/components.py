"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import written


def stars(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of every linked node but the roots, ``v`` the smallest node of its component.

    Alternates large-star and small-star steps.  Each writes its edges to the
    shared folder; group minima are aggregated before the shuffle, and a hub's
    edges in the joins are split by the adaptive planner.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def digest(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = written(edges, "star-edges")
    seen = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(nearest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where(F.col("u") != F.col("v")).distinct(), "star-edges")
        low = minima(large)
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star-edges")
        now = digest(edges)
        if now == seen:
            return edges
        seen = now
