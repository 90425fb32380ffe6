"""What the operators share: reading, held-out splits, names and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_folder  # noqa: F401  the operators take them from here

SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Returns freed memory of this worker to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_KEPT: dict = {}


def keep(key, make):
    """What ``make`` gives, kept between tasks of this worker under the key. Operators share the one place: what another one kept is let go first, so that the stages
    of a pipeline do not add up in their workers."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Lets go of what this worker keeps."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, as one task per core. Heap and direct buffers that a stage grew go back to the system; else they stay beside
    what the Python workers of the next one take. An executor whose cores are all busy may be left out, which costs memory and nothing else."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row; nulls stay."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end
        give_back()


def words_of(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space (0x20, 0x09-0x0D) of each text: starts (one more than texts), codes and the distinct words."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # a tenth of the time of to_pylist
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:
        keep = codes != words.index("")
        starts = np.concatenate(([0], np.cumsum(counts)))
        kept = np.concatenate(([0], np.cumsum(keep)))
        return kept[starts], codes[keep], words
    return np.concatenate(([0], np.cumsum(counts))), codes, words


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class HashIndex:
    """Numbers 64-bit hashes in the order they are added; 16 bytes each."""

    def __init__(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)  # in order they are looked up near one another
        own = hashes[order]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out = np.empty(len(hashes), np.int64)
        out[order] = np.where(self.keys[at] == own, self.place[at], -1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that are not yet known."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.place = np.insert(self.keys, at, hashes[order]), np.insert(self.place, at, len(self.place) + order)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]], 0 for empty runs."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


