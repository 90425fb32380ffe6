"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str = "stars", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node reachable; roots themselves are left out.

    Every round hangs larger neighbours, then smaller ones, on the least neighbour, until nothing moves. Each step is one min aggregation,
    combined before the shuffle, and one join, so a node of huge degree is never gathered in one place; each round is a written table.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = scratch.save(ordered, f"{name}-0"), None
    for i in range(1, most_rounds):
        # large star: v > u for every neighbour v of u moves to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = scratch.save(small.distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
