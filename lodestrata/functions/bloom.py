"""Bloom filters as relations: (bit) rows build, merge and answer with plain joins and aggregates."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import bucket_of

SEED_BASE = 7


def parameters(n: int, fp: float) -> tuple[int, int]:
    """Bits and hash functions for n items at a false-positive rate."""
    if n < 1 or not 0 < fp < 1:
        raise ValueError("n must be positive and 0 < fp < 1")
    m = math.ceil(n * abs(math.log(fp)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bits_of(x: Column, m: int, k: int, seed: int = SEED_BASE) -> Column:
    return F.array(*[bucket_of(x, seed + i, m) for i in range(k)])


def build(items: DataFrame, column: str, m: int, k: int, seed: int = SEED_BASE) -> DataFrame:
    """The set bits, one row each. Merging filters is a union with distinct."""
    distinct = items.select(F.col(column).cast("string").alias("x")).filter("x is not null").distinct()
    return distinct.select(F.explode(bits_of(F.col("x"), m, k, seed)).alias("bit")).distinct()


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.union(f)
    return out.distinct()


def membership(probes: DataFrame, column: str, bits: DataFrame, m: int, k: int, seed: int = SEED_BASE) -> DataFrame:
    """Each distinct probe with ``maybe``: whether all its bits are set."""
    asked = probes.select(F.col(column).cast("string").alias("x")).filter("x is not null").distinct()
    each = asked.select("x", F.explode(F.array_distinct(bits_of(F.col("x"), m, k, seed))).alias("bit"))
    hit = each.join(bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy("x").agg((F.count("*") == F.count("_set")).alias("maybe"))


def estimated_cardinality(bits: DataFrame, m: int, k: int) -> DataFrame:
    """Items that would set as many bits."""
    set_ = F.count("*").cast("double")
    return bits.agg(F.when(F.count("*") >= m, F.lit(None)).otherwise(F.round(-m / k * F.log(1 - set_ / m))).cast("bigint").alias("estimate"))


def expected_elements(filters: DataFrame, by: str, m: int, k: int) -> DataFrame:
    """How many elements a filter over the union of several, rows (by, bit), must expect: the sum of their estimates, which counts what they share more than once."""
    each = filters.groupBy(by).agg(F.count("*").cast("double").alias("set"))
    estimate = F.when(F.col("set") >= m, F.lit(None)).otherwise(F.round(-m / k * F.log(1 - F.col("set") / m))).cast("bigint")
    return each.agg(F.sum(estimate).alias("expected"))


class BloomState:
    """A filter as bytes, for the registry: size, hash functions, first seed, then the bits; little-endian."""

    def __init__(self, m: int, k: int, seed: int = SEED_BASE, bits: bytearray | None = None):
        self.m, self.k, self.seed = m, k, seed
        self.bits = bits or bytearray(-(-m // 8))

    def set_bits(self, positions) -> None:
        for p in positions:
            self.bits[p >> 3] |= 1 << (p & 7)

    def has_bits(self, positions) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in positions)

    HEAD = struct.Struct("<QII")

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.m, self.k, self.seed) + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomState:
        return cls(*cls.HEAD.unpack_from(data), bytearray(data[cls.HEAD.size :]))
