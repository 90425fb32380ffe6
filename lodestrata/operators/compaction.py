"""Merging of sorted runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latest import latest_per_key


def merge_runs(runs: list[DataFrame], bottom: bool) -> DataFrame:
    """Newest version of each key over all runs. Tombstones go only where no deeper run can hold an older version."""
    merged = latest_per_key(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs))
    return merged.filter(~F.col("tombstone")) if bottom else merged


def run_bounds(runs: DataFrame, by: str = "generation") -> DataFrame:
    """Key bounds, rows and distinct keys of every run."""
    return runs.groupBy(by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys")
    )


def overlapping(bounds: list[dict], low: str, high: str) -> list[dict]:
    """Of runs with bounds ``low`` and ``high`` those that may hold a key in [low, high]."""
    return [r for r in bounds if r["low"] <= high and r["high"] >= low]


def leveled_inputs(runs: list[dict], level: int, next_level: int) -> list[dict]:
    """The runs of a level with those of the next one that their keys reach into; only these must be merged for the next level's runs to stay apart."""
    own = [r for r in runs if r["level"] == level]
    if not own or next_level == level:
        return own
    low, high = min(r["low"] for r in own), max(r["high"] for r in own)
    return own + overlapping([r for r in runs if r["level"] == next_level], low, high)


def read_order(runs: DataFrame) -> DataFrame:
    """Levels from the top, and within a level the newest run first, with ``place`` from 1: the order in which a point read would visit runs."""
    place = F.row_number().over(W.orderBy(F.col("level").asc(), F.col("generation").desc()))  # one row per run
    return runs.withColumn("place", place)
