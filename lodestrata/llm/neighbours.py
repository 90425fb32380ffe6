"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are quantised to int8 with one scale each. A tile multiplies a block of queries by a block of candidates in whole numbers; the
rounding errors' norms bound how far each product can lie from the true one (Cauchy-Schwarz). A pair survives if its upper bound reaches
the k-th best lower bound of its query in the tile, and only survivors are computed again in double precision from the original vectors.
Heaps merge the tiles' lists. No neighbour is lost: the result is exact.

Equal vectors are stored once with their smallest ids, one more than k: ties go to smaller ids, so others could never be listed. A hot
vector is thus one candidate. Blocks are dealt by hash, so all have about the same size. A task holds two blocks and one tile. Candidates are sent once to
every block of queries, so these are as large as ``BLOCK_BYTES`` lets them be.

Defined cases: rows whose id is null, or whose vector is null, zero, or holds null or non-finite components take no part; rows that repeat an
id and vector count once; an id with several vectors is one neighbour, and one query, with the best score of them, and survivors are then counted in
that many times k; products too large for a double are infinite and rank accordingly, those that are no number last; vectors meet only others
of the same length; a query with fewer candidates than k lists all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions

BLOCK_BYTES = 16 << 20
CANDIDATE_ROWS = 8192
TILE_QUERIES = 512


def usable(vec: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the vectors, of their codes and of what rounding lost."""
    scale = np.abs(v).max(axis=1) / 127.0
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return codes, scale, norm(v), norm(back), norm(v - back)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last in double precision."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


def rankable(score):
    """The score, with minus infinity for what is no number."""
    return np.where(np.isnan(score), -np.inf, score)[()]


def tile(queries: np.ndarray, candidates: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, exact score) of the pairs that can be among the k best of a query in this tile."""
    cq, cs, cn, _, ce = quantise(candidates)
    right = cq.astype(np.float32).T  # whole numbers up to 127 * 127 * length stay exact in single precision up to length 1040
    wide = candidates.shape[1] > 1040
    for at in range(0, len(queries), TILE_QUERIES):
        q = queries[at : at + TILE_QUERIES]
        qq, qs, _, qb, qe = quantise(q)
        product = qq.astype(np.float64) @ right.astype(np.float64) if wide else qq.astype(np.float32) @ right
        with np.errstate(over="ignore", invalid="ignore"):
            middle = product * qs[:, None] * cs[None, :]
            error = (qe[:, None] * cn[None, :] + qb[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-9 * np.abs(middle)
            lower = middle - error
            upper = middle + error
        open_ = ~np.isfinite(upper) | ~np.isfinite(lower)  # too large to bound: such pairs are computed
        lower[open_], upper[open_] = -np.inf, np.inf
        kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k] if lower.shape[1] > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(upper >= kth[:, None])
        yield i + at, j, exact(q[i], candidates[j])


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int | None = None, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query row with all rows of other ids."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    own = own.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q"))
    scratch = Scratch(spark, "neighbours")
    own = scratch.save(own, "own")
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = own.select("id", "v", rank.alias("r")).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cands = scratch.save(few, "candidates")
    asked = scratch.save(own.filter("q").select("id", "v"), "queries")
    most = own.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1  # vectors of one id
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    query_rows = query_rows or max(1, BLOCK_BYTES // (8 * (size["dim"] or 1)))
    n_cand, n_query = max(1, -(-cands.count() // candidate_rows)), max(1, -(-size["n"] // query_rows))
    dim = F.size("v").alias("dim")
    left = asked.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(n_query)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb"))
    right = cands.select("ids", "v", dim, F.pmod(F.xxhash64("v"), F.lit(n_cand)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("qb"))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            qid, ids = a.column("id").to_pylist(), b.column("ids").to_pylist()
            for i, j, score in tile(matrix(a), matrix(b), (k + 1) * most):
                order = np.lexsort((-rankable(score), i))
                i, j, score = i[order], j[order], score[order]
                edges = np.flatnonzero(np.diff(i)) + 1
                for s, e in zip([0, *edges], [*edges, len(i)], strict=True):
                    if e > s:
                        own_id = qid[i[s]]
                        best = heapq.nsmallest(k * most, ((-rankable(score[x]), other, score[x]) for x in range(s, e) for other in ids[j[x]] if other != own_id))
                        out.append((own_id, [x[1] for x in best], [float(x[2]) for x in best]))
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "ids": pa.array([r[1] for r in out], pa.list_(pa.int64())), "scores": pa.array([r[2] for r in out], pa.list_(pa.float64()))})

    keys = ("dim", "qb", "cb")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, "query_id long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a query follow one another; one heap of at most k candidates is open at a time, with the best score of each id in it."""
        current, heap, held, out = None, [], {}, []

        def close() -> None:
            seen = sorted((-s, -o, x) for s, o, x in heap if held.get(-o) == s)
            out.extend((current, r, o, x) for r, (_, o, x) in enumerate(seen[:k], 1))

        for pdf in batches:
            for q, ids, scores in zip(pdf["query_id"], pdf["ids"], pdf["scores"], strict=True):
                if q != current:
                    close()
                    current, heap, held = q, [], {}
                for o, x in zip(ids, scores, strict=True):
                    s = rankable(x)
                    if o in held and held[o] >= s:
                        continue
                    held[o] = s  # an older entry of this id is no longer valid
                    heapq.heappush(heap, (s, -o, x))
                    while len(held) > k:
                        s0, o0, _ = heapq.heappop(heap)
                        if held.get(-o0) == s0:
                            del held[-o0]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    dealt = lists.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id")
    return dealt.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")
