"""HyperLogLog as a relation of registers, and the built-in sketch for production use."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import fnv1a64, leading_bits, trailing_zeros

# Fixed values of the estimator.
ALPHA_FACTOR, ALPHA_TERM, SMALL, TWO_32 = 0.7213, 1.079, 2.5, 4294967296.0


def check_precision(p: int) -> None:
    if not 4 <= p <= 16:
        raise ValueError("the precision runs from 4 to 16")


def registers(items: DataFrame, column: str, p: int) -> DataFrame:
    """Non-empty registers (bucket, rank): the top p bits choose, the greatest count of trailing zeros stays."""
    check_precision(p)
    h = items.select(F.col(column).cast("string").alias("x")).filter("x is not null").distinct().select(fnv1a64(F.col("x")).alias("h"))
    return h.groupBy(leading_bits(F.col("h"), p).alias("bucket")).agg(F.max(trailing_zeros(F.col("h"))).alias("rank"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("bucket").agg(F.max("rank").alias("rank"))


def estimate(regs: DataFrame, p: int) -> DataFrame:
    """Harmonic mean with the small- and large-range corrections; empty registers count as rank 0."""
    check_precision(p)
    m = 1 << p
    filled, total = F.count("*"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0))
    raw = (ALPHA_FACTOR / (1 + ALPHA_TERM / m)) * m * m / (total + (m - filled))
    base = regs.agg(raw.alias("raw"), F.greatest(F.lit(m) - F.count_if(F.col("rank") > 0), F.lit(0)).alias("empty"))
    small = m * F.log(m / F.col("empty"))
    large = -TWO_32 * F.log(1 - F.col("raw") / TWO_32)
    value = F.when((F.col("raw") <= SMALL * m) & (F.col("empty") > 0), small).when(F.col("raw") > TWO_32 / 30, large).otherwise(F.col("raw"))
    return base.select(value.alias("estimate"))


def production(items: DataFrame, column: str, by: list[str] | None = None, lg: int = 12) -> DataFrame:
    """Mergeable distinct counts with the built-in sketch."""
    return items.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, lg)).alias("estimate"))


class HllState:
    """Registers as bytes, for the registry: the precision, then one byte each."""

    def __init__(self, p: int, regs: bytearray | None = None):
        check_precision(p)
        self.p, self.regs = p, regs or bytearray(1 << p)

    def update(self, pairs) -> None:
        for bucket, rank in pairs:
            self.regs[bucket] = max(self.regs[bucket], rank)

    def to_bytes(self) -> bytes:
        return struct.pack("B", self.p) + bytes(self.regs)

    @classmethod
    def from_bytes(cls, data: bytes) -> HllState:
        return cls(data[0], bytearray(data[1:]))
