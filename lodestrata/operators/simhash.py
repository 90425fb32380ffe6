"""128-bit SimHash fingerprints, Hamming distance and near-duplicate pairs.

A row is a document: its tokens are counted, hashed and summed where the row is, in Arrow batches, so the corpus is not shuffled.

Defined cases: a null text, and one without tokens, has no counts and no fingerprint; rows that repeat an id are documents each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 128
# Fixed value: the characters with Unicode's White_Space property.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SLICE_BYTES = 4 << 20
SUM_TOKENS = 1 << 15


def tokens(text: Column) -> Column:
    """Pieces between single spaces, trimmed of Unicode white space; empty ones go."""
    trimmed = F.transform(F.split(text, " "), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """ids, the document and token number of every token, and the distinct tokens, for about SLICE_BYTES of text at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(at, end - at)
            lists = pc.split_pattern(pc.fill_null(part.column(1), ""), " ")
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = pc.utf8_trim(lists.flatten(), characters=SPACES).dictionary_encode()
            codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            doc = np.repeat(np.arange(part.num_rows), many)
            if "" in words:
                keep = codes != words.index("")
                doc, codes = doc[keep], codes[keep]
            yield part.column(0), doc, codes, words
            at = end


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, n), counted inside each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, codes, words in _slices(batches):
            pairs, n = np.unique(doc.astype(np.int64) * max(1, len(words)) + codes, return_counts=True)
            d, w = pairs // max(1, len(words)), pairs % max(1, len(words))
            yield pa.record_batch([ids.take(pa.array(d)), pa.array(words, pa.string()).take(pa.array(w)), pa.array(n)], [id_col, "token", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, token string, n long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex). Bit i is 1 if the weighted sum of the tokens' md5 bits is above 0; a digest is read from its highest bit, a fingerprint byte
    is filled from its lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, codes, words in _slices(batches):
            digest = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words), np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(digest, axis=1).astype(np.int8) * 2 - 1
            sums = np.zeros((len(ids), BITS), np.int64)
            for a in range(0, len(doc), SUM_TOKENS):
                d = doc[a : a + SUM_TOKENS]
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                sums[d[first]] += np.add.reduceat(bits[codes[a : a + SUM_TOKENS]], first, axis=0, dtype=np.int64)
            some = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
            hexed = [row.tobytes().hex() for row in np.packbits(sums[some] > 0, axis=1, bitorder="little")]
            yield pa.record_batch([ids.take(pa.array(some)), pa.array(hexed, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def bit_string(fingerprint: Column) -> Column:
    """A fingerprint in hex as 128 zeros and ones, each byte from its highest bit."""
    half = lambda at: F.lpad(F.conv(F.substring(fingerprint, at, 16), 16, 2), 64, "0")
    return F.concat(half(1), half(17))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hex."""
    half = lambda x, at: F.conv(F.substring(x, at, 16), 16, -10).cast("bigint")
    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 17)), F.lit(0)).cast("int")


def near_pairs(prints: DataFrame, distance: int, id_col: str = "doc_id") -> DataFrame:
    """Pairs of distinct fingerprints within ``distance`` bits (14 at most), each named by its smallest id; ``representatives`` has the members. Cut into
    ``distance`` + 2 parts, two such fingerprints agree on two parts at least, so candidates meet on pairs of parts, and a pair is kept at the
    first it shares."""
    if not 0 <= distance <= 14:
        raise ValueError("the distance runs from 0 to 14")
    reps = prints.groupBy("fingerprint").agg(F.min(id_col).alias("rep"))
    parts = distance + 2  # two whole parts stay equal
    cut = [round(32 * i / parts) for i in range(parts + 1)]
    piece = lambda c, i: F.substring(c, cut[i] + 1, cut[i + 1] - cut[i])
    both = [(i, j) for i in range(parts) for j in range(i + 1, parts)]
    keys = [F.struct(F.lit(n).alias("no"), F.concat(piece("fingerprint", i), piece("fingerprint", j)).alias("part")) for n, (i, j) in enumerate(both)]
    banded = reps.select("rep", "fingerprint", F.explode(F.array(*keys)).alias("k")).select("rep", "fingerprint", "k.no", "k.part")
    a, b = banded.alias("a"), banded.alias("b")
    met = a.join(b, (F.col("a.no") == F.col("b.no")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rep") < F.col("b.rep")))
    equal = [piece(F.col("a.fingerprint"), i) == piece(F.col("b.fingerprint"), i) for i in range(parts)]
    first = F.coalesce(*[F.when(equal[i] & equal[j], F.lit(n)) for n, (i, j) in enumerate(both)])
    d = hamming(F.col("a.fingerprint"), F.col("b.fingerprint"))
    return met.filter((d <= distance) & (F.col("a.no") == first)).select(F.col("a.rep").alias("id_a"), F.col("b.rep").alias("id_b"), d.alias("distance"))


def representatives(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every id with the smallest id of its fingerprint."""
    reps = prints.groupBy("fingerprint").agg(F.min(id_col).alias("rep"))
    return prints.join(reps, "fingerprint").select(F.col(id_col), "rep")
