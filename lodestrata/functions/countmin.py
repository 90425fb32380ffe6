"""Count-Min sketches as relations: (row, bucket, cnt)."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import bucket_of

SEED_BASE = 101


def parameters(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth. The depth has one row more than the usual ln(1/delta)."""
    if epsilon <= 0 or not 0 < delta <= 1:
        raise ValueError("epsilon must be positive and 0 < delta <= 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cells_of(x: Column, m: int, k: int, seed: int = SEED_BASE) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("row"), bucket_of(x, seed + i, m).alias("bucket")) for i in range(k)])


def build(items: DataFrame, column: str, m: int, k: int, seed: int = SEED_BASE) -> DataFrame:
    """Items are counted before they are spread over the rows, so the explode sees distinct items only."""
    counted = items.select(F.col(column).cast("string").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    cell = counted.select("n", F.explode(cells_of(F.col("x"), m, k, seed)).alias("c"))
    return cell.groupBy(F.col("c.row").alias("row"), F.col("c.bucket").alias("bucket")).agg(F.sum("n").alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def estimate(probes: DataFrame, column: str, sketch: DataFrame, m: int, k: int, seed: int = SEED_BASE) -> DataFrame:
    """Each distinct probe with the least of its counters; 0 means not found."""
    asked = probes.select(F.col(column).cast("string").alias("x")).filter("x is not null").distinct()
    each = asked.select("x", F.explode(cells_of(F.col("x"), m, k, seed)).alias("c")).select("x", "c.row", "c.bucket")
    return each.join(sketch, ["row", "bucket"], "left").groupBy("x").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


class CountMinState:
    """A sketch as bytes, for the registry."""

    def __init__(self, m: int, k: int, seed: int = SEED_BASE, cells: list[int] | None = None):
        self.m, self.k, self.seed, self.cells = m, k, seed, cells or [0] * (m * k)

    def add(self, cells) -> None:
        for row, bucket, n in cells:
            self.cells[row * self.m + bucket] = min(self.cells[row * self.m + bucket] + n, 0xFFFFFFFF)

    def query(self, cells) -> int:
        return min(self.cells[row * self.m + bucket] for row, bucket in cells)

    HEAD = struct.Struct("<QII")

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.m, self.k, self.seed) + struct.pack(f"<{self.m * self.k}I", *self.cells)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountMinState:
        m, k, seed = cls.HEAD.unpack_from(data)
        return cls(m, k, seed, list(struct.unpack_from(f"<{m * k}I", data, cls.HEAD.size)))
