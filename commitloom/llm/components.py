"""Connected components of a distributed edge table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component: its least node.

    Alternating stars: the large star hangs each node's greater neighbours on
    the least of its neighbourhood, the small star its lesser ones. Groups are
    only ever reduced to a minimum before they shuffle, each round's edges are a
    written table, and the rounds end when the edges stay as they are, a number
    that grows with the logarithm of a component's size. Loops and null ends are
    no edges; repeated edges count once; without edges the result is empty.
    """
    e = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    e, before = store(e), None
    while before != (now := _digest(e)):
        e, before = store(_small_star(_large_star(e))), now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)


def _digest(e: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(e.agg(F.count("*"), total).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    far = both.where("b > a").join(least, "a")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", "m")).distinct()
