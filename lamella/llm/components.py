"""Connected components by alternating large and small stars; every round is two joins on aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _with_least(pairs: DataFrame, write: bool) -> DataFrame:
    """(u, v) pairs with the least v of each u. Written minima leave a join of two plain exchanges, which the planner splits at a node with very many pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "mu")
    least = cut(least, "least") if write else least
    return pairs.join(least, pairs["u"] == least["mu"]).drop("mu")


def components(links: DataFrame) -> DataFrame:
    """node, class (its least member) for every node of links (a, b: long). Nodes without links don't appear."""
    ends = links.where("a <> b")
    edges = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True).select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("by")).where("u > by and u <> v").select("u", "v").distinct()
        near = _with_least(large, False)  # few pairs for each node are left here
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(tops.select("node", F.col("node").alias("class")))
