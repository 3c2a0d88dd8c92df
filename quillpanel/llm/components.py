"""Connected components of an edge table, by joins and counts on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its neighbours; summed before the shuffle, stored so that the
    join that follows can split a node with very many neighbours."""
    return stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node of the edges; the label is the smallest node that can be reached.

    Alternates two steps until nothing changes: each node links its larger
    neighbours to the smallest one it knows, then its smaller ones.  Labels
    travel over chains in logarithmically many rounds.
    """
    lower = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = lower.unionAll(lower.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v"))
        least = _smallest(large)
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = stored(moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = lower.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    roots = lower.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return lower.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
