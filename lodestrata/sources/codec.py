"""Binary codecs for exchanging change logs with block-structured log files.

An entry is crc32 | time u64 | tombstone u8 | key length u64 | key | value length u64 | value, little-endian, the checksum
covering all that follows it. Entries are laid into fixed-size blocks of crc32 | kind u8 | length u32 | data; an entry that
fits no single block is cut over a first, any number of middle, and a last block.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..schema import KV_SCHEMA

FULL, FIRST, MIDDLE, LAST = 0, 1, 2, 3  # fixed values: block kinds
HEADER = struct.Struct("<IBI")
BLOCK_SIZES = (4096, 8192, 16384)


class Entry(NamedTuple):
    key: bytes
    value: bytes
    ts: int
    tombstone: bool


class Corrupt(ValueError):
    pass


def encode_entry(e: Entry) -> bytes:
    body = struct.pack("<QBQ", e.ts, e.tombstone, len(e.key)) + e.key + struct.pack("<Q", len(e.value)) + e.value
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_entries(data: bytes) -> Iterator[Entry]:
    at = 0
    while at < len(data):
        crc, ts, dead, n = struct.unpack_from("<IQBQ", data, at)
        mid = at + 21 + n
        (m,) = struct.unpack_from("<Q", data, mid)
        end = mid + 8 + m
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            raise Corrupt(f"entry at byte {at}")
        yield Entry(data[at + 21 : mid], data[mid + 8 : end], ts, bool(dead))
        at = end


def _block(kind: int, data: bytes, size: int) -> bytes:
    head = struct.pack("<BI", kind, len(data))
    return (struct.pack("<I", zlib.crc32(head + data)) + head + data).ljust(size, b"\0")


def pack(entries: Iterable[Entry], size: int = 4096) -> Iterator[bytes]:
    """Blocks of ``size`` bytes; whole entries share a block as long as they fit."""
    if size not in BLOCK_SIZES:
        raise ValueError(f"block sizes are {BLOCK_SIZES}")
    room, open_ = size - HEADER.size, b""
    for raw in map(encode_entry, entries):
        if open_ and len(open_) + len(raw) > room:
            yield _block(FULL, open_, size)
            open_ = b""
        if len(raw) <= room:
            open_ += raw
            continue
        parts = [raw[i : i + room] for i in range(0, len(raw), room)]
        for i, part in enumerate(parts):
            yield _block(FIRST if i == 0 else LAST if i == len(parts) - 1 else MIDDLE, part, size)
    if open_:
        yield _block(FULL, open_, size)


def unpack(data: bytes, size: int = 4096) -> Iterator[Entry]:
    pending = b""
    for at in range(0, len(data), size):
        crc, kind, n = HEADER.unpack_from(data, at)
        body = data[at + 4 : at + HEADER.size + n]
        if zlib.crc32(body) != crc:
            raise Corrupt(f"block at byte {at}")
        if kind == FULL:
            yield from decode_entries(body[5:])
        else:
            pending = (b"" if kind == FIRST else pending) + body[5:]
            if kind == LAST:
                yield from decode_entries(pending)
                pending = b""


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number and the position after it."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def zigzag(n: int) -> bytes:
    """A signed 64-bit number, small ones of either sign in few bytes."""
    return uvarint((n << 1 ^ n >> 63) & (1 << 64) - 1)


def read_zigzag(data: bytes, at: int = 0) -> tuple[int, int]:
    n, at = read_uvarint(data, at)
    return n >> 1 ^ -(n & 1), at


def encode_header(e: Entry) -> bytes:
    """The variable-length header of an entry, for compact files: time (zig-zag), tombstone, key length, and the value's length unless it is deleted."""
    return zigzag(e.ts) + bytes([e.tombstone]) + uvarint(len(e.key)) + (b"" if e.tombstone else uvarint(len(e.value)))


def decode_header(data: bytes, at: int = 0) -> tuple[int, bool, int, int, int]:
    """Time, tombstone, key length, value length, and the place after the header."""
    ts, at = read_zigzag(data, at)
    dead = bool(data[at])
    n, at = read_uvarint(data, at + 1)
    m, at = (0, at) if dead else read_uvarint(data, at)
    return ts, dead, n, m, at


def pack_log(log: DataFrame, size: int = 4096) -> DataFrame:
    """A change log as segments of blocks, (segment, content), one per partition, entries in order of time."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        entries = (Entry(k.encode(), (v or "").encode(), t, d) for pdf in batches for k, v, t, d in zip(pdf["key"], pdf["value"], pdf["ts"], pdf["tombstone"], strict=True))
        content = b"".join(pack(entries, size))
        if content:
            yield pd.DataFrame({"segment": [TaskContext.get().partitionId()], "content": [content]})

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return log.select("key", "value", "ts", "seq", "tombstone").repartitionByRange(n, "ts", "seq").sortWithinPartitions("ts", "seq").mapInPandas(run, "segment long, content binary")


def unpack_log(segments: DataFrame, size: int = 4096) -> DataFrame:
    """The change log in segments of blocks, every checksum verified; ``seq`` orders by segment, then by place."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for number, content in zip(pdf["segment"], pdf["content"], strict=True):
                rows = [(e.key.decode(), None if e.tombstone else e.value.decode(), e.ts, (int(number) << 32) + i, e.tombstone) for i, e in enumerate(unpack(bytes(content), size))]
                yield pd.DataFrame(rows, columns=[f.name for f in KV_SCHEMA.fields])

    return segments.mapInPandas(run, KV_SCHEMA)


def segment_number(name: str) -> int:
    """The last number in a segment's file name."""
    return int(re.findall(r"\d+", name.rsplit("/", 1)[-1])[-1])


def read_log(spark: SparkSession, path: str, size: int = 4096, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Log segment files as a change log, from ``start`` (segment, block) on. A segment is one row of the reader, so segments are the unit of work; ``seq``
    orders by the number in the segment's name, then by place in what is read of it."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                number = segment_number(name)
                if number >= start[0]:
                    data = bytes(content)[start[1] * size if number == start[0] else 0 :]
                    rows = [(e.key.decode(), None if e.tombstone else e.value.decode(), e.ts, (number << 32) + i, e.tombstone) for i, e in enumerate(unpack(data, size))]
                    yield pd.DataFrame(rows, columns=[f.name for f in KV_SCHEMA.fields])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, KV_SCHEMA)
