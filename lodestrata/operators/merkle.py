"""Merkle trees as tables (level, idx, hash), level 0 the leaves.

A run is read once: its leaves get their places and are written. Then blocks of ``FAN`` nodes are folded ten levels at a time inside a row, which
leaves one node in ``FAN`` for the next step, so a tree of any size takes a few shuffles of ever fewer rows.

Defined cases: an empty run has no nodes; a single leaf is the root; of rows that repeat a key the places follow the leaf hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import le32
from ..sources.scratch import Scratch

FOLD = 10
FAN = 1 << FOLD


def crc_leaf(payload: Column) -> Column:
    return F.crc32(payload)


def crc_parent(left: Column, right: Column) -> Column:
    """A missing right child hashes as the crc of nothing, 0."""
    return F.crc32(F.concat(le32(left), le32(F.coalesce(right, F.lit(0).cast("bigint")))))


def md5_leaf(payload: Column) -> Column:
    return F.md5(payload)


def md5_parent(left: Column, right: Column) -> Column:
    return F.md5(F.encode(F.concat(left, F.coalesce(right, F.lit(""))), "utf-8"))


def leaves(run: DataFrame, payload: Column, leaf: Callable[[Column], Column] = crc_leaf) -> DataFrame:
    """Leaves in key order. They are dealt by key range and written with their range's number, so that counts and places rest on the same dealing; no
    task sees the whole run."""
    spark = run.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = run.select("key", leaf(payload).alias("hash")).repartitionByRange(n, "key").withColumn("_p", F.spark_partition_id())
    dealt = Scratch(spark, "merkle").save(dealt, "leaves")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("c"))
    start = sizes.select("_p", (F.sum("c").over(W.orderBy("_p")) - F.col("c")).alias("s"))  # one row per range
    within = dealt.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("key", "hash")) - 1)
    return within.join(F.broadcast(start), "_p").select(F.lit(0).alias("level"), (F.col("_i") + F.col("s")).alias("idx"), "hash")


def _folded(nodes: Column, levels: int, parent: Callable[[Column, Column], Column]) -> Column:
    """The levels above neighbouring nodes, as arrays, the nodes themselves first."""

    def step(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        places = F.sequence(F.lit(0), ((F.size(last) + 1) / 2).cast("int") - 1)
        return F.concat(done, F.array(F.transform(places, lambda i: parent(F.get(last, i * 2), F.get(last, i * 2 + 1)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(nodes), step)


def build(bottom: DataFrame, parent: Callable[[Column, Column], Column] = crc_parent) -> DataFrame:
    """All levels up to the root; an empty run has none."""
    scratch = Scratch(bottom.sparkSession, "merkle")
    bottom = scratch.save(bottom.select(F.col("level").cast("int").alias("level"), "idx", "hash"), "level-0")
    left = max(0, bottom.count() - 1).bit_length()  # levels above the leaves
    parts, here, level = [bottom], bottom, 0
    while left:
        take = min(FOLD, left)
        block = here.groupBy(F.shiftright("idx", FOLD).alias("b")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash")))["hash"].alias("nodes"))  # FAN nodes at most
        done = block.select("b", F.posexplode(F.slice(_folded(F.col("nodes"), take, parent), 2, take)).alias("up", "hashes"))
        each = done.select((F.col("up") + level + 1).alias("level"), "b", "up", F.posexplode("hashes").alias("i", "hash"))
        first = F.expr(f"shiftleft(b, {FOLD} - 1 - up)")
        made = scratch.save(each.select("level", (first + F.col("i")).alias("idx"), "hash"), f"level-{level + take}")
        level, left = level + take, left - take
        parts.append(made)
        here = made.filter(F.col("level") == level)
    return reduce(DataFrame.unionByName, parts)


def root(tree: DataFrame) -> DataFrame:
    return tree.agg(F.max_by("hash", "level").alias("root"), (F.max("level") + 1).alias("n_levels"))


def diff(stored: DataFrame, current: DataFrame, level: int | None = 0) -> DataFrame:
    """Positions whose hashes differ, missing ones included; level None compares every node."""
    pick = lambda t: t if level is None else t.filter(F.col("level") == level)
    a = pick(stored).withColumnRenamed("hash", "stored_hash")
    b = pick(current).withColumnRenamed("hash", "current_hash")
    return a.join(b, ["level", "idx"], "full_outer").filter(~F.col("stored_hash").eqNullSafe(F.col("current_hash")))


def to_bytes(tree: DataFrame) -> bytes:
    """A crc tree as bytes, for exchange of small trees: the number of leaves u64, the hashes u32 level by level from the leaves, and a crc of all that
    u32; little-endian. The nodes come to the driver, four bytes each."""
    rows = tree.orderBy("level", "idx").select("level", "hash").collect()
    body = struct.pack(f"<Q{len(rows)}I", sum(r["level"] == 0 for r in rows), *(r["hash"] for r in rows))
    return body + struct.pack("<I", zlib.crc32(body))


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """The tree of ``to_bytes``; damage raises."""
    body = data[:-4]
    if len(data) < 12 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(body):
        raise ValueError("damaged tree")
    (n,), at, level, rows = struct.unpack_from("<Q", body), 8, 0, []
    while n:
        rows += [(level, i, h) for i, h in enumerate(struct.unpack_from(f"<{n}I", body, at))]
        at, level, n = at + 4 * n, level + 1, (n + 1) // 2 if n > 1 else 0
    if at != len(body):
        raise ValueError("damaged tree")
    return spark.createDataFrame(rows, "level int, idx long, hash long")
