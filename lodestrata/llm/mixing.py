"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget; it takes ``whole`` copies of all its documents, and for the rest documents are counted by exact length
and a bounded knapsack picks how many of each length to take once more. Which ones is decided by a seeded hash, so that reruns agree.

Lengths are counted on the cluster. A source's length histogram has as many rows as it has distinct lengths, whatever its documents;
the knapsack runs per source on that. Sources alone (name, words) come to the driver. Documents of a length are then picked in two
steps, quotas per hash bucket and ranks inside one. There are as many buckets as the square root of the documents' number, so neither step orders more
than about that many rows in one task, even if all documents are of one source and length.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last; rows that repeat an
id are documents of their own, told apart by text hash and otherwise alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
LEAST_BUCKETS = 256
DP_WORDS = 1 << 16


def word_count(text: Column) -> Column:
    """Words between ASCII white space: a word starts wherever one follows white space or the beginning."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_REPEATS) -> list[float]:
    """Budgets of sources in order: all words shared by weight; a source stops at ``cap`` times its size and the excess is shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(n for _, n in sizes))
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / total > cap * sizes[i][1]}
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in sorted(over):
            out[i] = float(cap * sizes[i][1])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def fit(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    The same share of every length is taken first, then the longest that fit, until what is left is small against ``dp_words`` or
    nothing fits; a bounded knapsack over reachable sums settles the rest, going just past the budget where that comes nearer, be it by
    one document longer than the knapsack is wide.
    """
    total = sum(x * n for x, n in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    share = max(0.0, (budget - dp_words // 2) / total) if total else 0.0
    taken = [int(n * share) for n in counts]
    left = budget - sum(x * t for x, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= dp_words:
            break
        if lengths[i]:
            more = min(counts[i] - taken[i], max(0, left - dp_words // 2) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    # bounded knapsack on bit sets: bit s of a set says that s words can be reached
    width = max(0, left) + max((lengths[i] for i in order if lengths[i] <= 2 * dp_words), default=0)
    mask, items, reach = (1 << (width + 1)) - 1, [], [1]
    for i in reversed(order):
        room = counts[i] - taken[i]
        if not 0 < lengths[i] <= width or not room:
            continue
        room, size = min(room, width // lengths[i]), 1
        while room:
            step = min(size, room)
            items.append((i, step))
            reach.append((reach[-1] | reach[-1] << (step * lengths[i])) & mask)
            room, size = room - step, size * 2
        if len(reach) > 4 and reach[-1] >> max(0, left) & 1:
            break
    sums = reach[-1]
    below = (sums & ((1 << (max(0, left) + 1)) - 1)).bit_length() - 1
    above = sums >> (max(0, left) + 1)
    at = below
    if above and left >= 0:
        first = max(0, left) + 1 + (above & -above).bit_length() - 1
        at = first if first - left < left - below else below
    # a document longer than the bit sets goes past the budget by itself, the shortest by least
    long, which = min(((lengths[i], i) for i in order if lengths[i] > width and counts[i] > taken[i]), default=(0, -1))
    if long and abs(long - left) < abs(at - left):
        taken[which] += 1
        return taken
    for k in range(len(items), 0, -1):
        i, step = items[k - 1]
        if not reach[k - 1] >> at & 1:
            taken[i] += step
            at -= step * lengths[i]
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, one row per document; with ``keep_rows`` also ``row``, a struct of all of its columns."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("_s"),  # no null, so that joins are plain
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.lit(seed)).alias("_h"),
        *([F.struct(*docs.columns).alias("row")] if keep_rows else []),
    ).withColumn("_b", F.pmod("_h", F.lit(max(LEAST_BUCKETS, math.isqrt(docs.count())))).cast("int"))
    counted = Scratch(spark, "mixing").save(sized.groupBy("_s", "size", "_b").agg(F.count("*").alias("n")), "lengths")
    sums = counted.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()  # one row per source
    sources = sorted(((r["_s"], r["words"]) for r in sums), key=lambda r: (r[0] == "", r[0].encode()))
    names, words = [s for s, _ in sources], [n for _, n in sources]
    columns = [pa.array(names, pa.string()), pa.array(words, pa.int64()), pa.array(targets(sources, weights, cap), pa.float64())]
    plan = spark.createDataFrame(pa.table(columns, ["_s", "source_size", "target"]))  # as an Arrow table: a list would start Python workers of another kind, which stay for a minute

    def knapsack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        words, target = int(pdf["source_size"][0]), float(pdf["target"][0])
        whole = min(cap, int(target // words)) if words else 0
        rest = 0 if whole == cap else max(0, round(target - whole * words))
        more = fit([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], rest)
        return pd.DataFrame({"_s": pdf["_s"], "size": pdf["size"], "source_size": words, "target": target, "whole": whole, "more": more})

    lengths = counted.groupBy("_s", "size").agg(F.sum("n").alias("n")).join(plan, "_s")
    fitted = lengths.groupBy("_s").applyInPandas(knapsack, "_s string, size long, source_size long, target double, whole int, more long")
    before = F.sum("n").over(W.partitionBy("_s", "size").orderBy("_b")) - F.col("n")  # one row per bucket at most
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before")))
    shares = counted.withColumn("before", before).join(fitted, ["_s", "size"]).select("_s", "size", "_b", "n", "source_size", "target", "whole", quota.alias("quota"))
    rank = F.row_number().over(W.partitionBy("_s", "size", "_b").orderBy("_h", "doc_id"))
    copies = F.col("whole") + F.when(F.col("quota") >= F.col("n"), 1).when(F.col("quota") <= 0, 0).otherwise((rank <= F.col("quota")).cast("int"))
    copies = F.when(F.col("size") == 0, 0).otherwise(copies)
    return sized.join(shares, ["_s", "size", "_b"]).withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep_rows else [])
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document taken twice is two rows, one not taken is none."""
    taken = mix(docs, weights, cap, seed, keep_rows=True).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
