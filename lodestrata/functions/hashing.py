"""Hash functions as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits. The prime is 2^40 + 435.
FNV_OFFSET = 0xCBF29CE484222325
FNV_LOW = 435


def signed(x: int) -> int:
    """An unsigned 64-bit value as Spark's bigint."""
    return x - (1 << 64) if x >> 63 else x


def seed_bytes(seed: int) -> Column:
    return F.unhex(F.lit(f"{seed & 0xFFFFFFFF:08x}"))


def seeded_md5_64(x: Column, seed: int) -> Column:
    """64-bit hash as bigint (its bits; read as unsigned): the first 8 bytes, big-endian, of md5(bytes of x, then the seed's 4)."""
    digest = F.md5(F.concat(F.encode(x.cast("string"), "utf-8"), seed_bytes(seed)))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def unsigned_mod(h: Column, m: int) -> Column:
    """The remainder of a bigint read as unsigned, from its halves; m is below 2^31."""
    if not 0 < m < 1 << 31:
        raise ValueError("m runs from 1 to 2^31 - 1")
    high = F.shiftrightunsigned(h, 32) % m * ((1 << 32) % m)
    return (high + h.bitwiseAND(F.lit(0xFFFFFFFF)) % m) % m


def bucket_of(x: Column, seed: int, m: int) -> Column:
    return unsigned_mod(seeded_md5_64(x, seed), m)


def fnv1a64(x: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as bigint. The product is built from 32-bit halves, so that nothing overflows; a byte of binary data is found by its place, so
    the work is linear in the text."""
    raw = F.encode(x.cast("string"), "utf-8")
    mask = F.lit(0xFFFFFFFF)

    def step(acc: Column, i: Column) -> Column:
        v = acc.bitwiseXOR(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
        low = v.bitwiseAND(mask) * FNV_LOW
        high = F.shiftrightunsigned(v, 32) * FNV_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(v.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))

    n = F.octet_length(raw)
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, F.lit(signed(FNV_OFFSET)).cast("bigint"), step)


def trailing_zeros(h: Column) -> Column:
    """Zero bits below the lowest one; 64 for 0. The lowest bigint is set apart since its negation overflows."""
    lowest = F.bit_count(F.when((h == 0) | (h == F.lit(-(1 << 63))), F.lit(1).cast("bigint")).otherwise(h.bitwiseAND(-h)) - 1)
    return F.when(h == 0, 64).when(h == F.lit(-(1 << 63)), 63).otherwise(lowest).cast("int")


def leading_bits(h: Column, p: int) -> Column:
    return F.shiftrightunsigned(h, 64 - p)


def le32(v: Column) -> Column:
    """A 32-bit value as 4 little-endian bytes."""
    hx = F.lpad(F.hex(v), 8, "0")
    return F.unhex(F.concat(F.substring(hx, 7, 2), F.substring(hx, 5, 2), F.substring(hx, 3, 2), F.substring(hx, 1, 2)))
