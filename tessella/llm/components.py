"""Connected components of an edge table by alternating star contraction, each step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node hangs on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it hang on the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    below = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): each node of the edges (u, v) with the smallest node it is connected to. The number of steps grows
    with the logarithm of the longest path; a step's table has at most as many rows as the one before."""
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = saved(edges.where("u <> v"), "edges")
    before = state(edges)
    while before[0]:
        edges = saved(_small_star(_large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
