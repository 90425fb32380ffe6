"""The change-log schema and the engine's options."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KV_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
    ]
)

# Prefixes and names that user keys may not use.
RESERVED_PREFIXES = ("bf_", "cms_", "hpp_", "sh_")
RESERVED_KEYS = ("token_bucket_state",)


@dataclass(frozen=True)
class EngineOptions:
    """Settings of a store. ``run_rows`` single writes are gathered before they become a run; ``merge_threshold`` runs of a level are merged; ``cache_size``
    point reads are kept; the bucket's two limit the rate of a limited store; ``bloom_fp`` is the error of the runs' key filters;
    ``compaction`` is ``size`` or ``leveled``; with ``trees`` every run gets its Merkle tree when it is written."""

    run_rows: int = 10
    merge_threshold: int = 3
    max_levels: int = 5
    cache_size: int = 5
    bucket_capacity: int = 10
    bucket_reset_ms: int = 1000
    bloom_fp: float = 0.01
    compaction: str = "size"
    trees: bool = False
    block_size: int = 4096
    segment_blocks: int = 16

    def __post_init__(self) -> None:
        if min(self.run_rows, self.merge_threshold, self.max_levels, self.cache_size, self.bucket_capacity, self.bucket_reset_ms, self.segment_blocks) < 1:
            raise ValueError("sizes must be positive")
        if not 0 < self.bloom_fp < 1:
            raise ValueError("bloom_fp must lie between 0 and 1")
        if self.compaction not in ("size", "leveled"):
            raise ValueError("compaction is size or leveled")

    @classmethod
    def load(cls, path: str | Path) -> EngineOptions:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))


def is_reserved(key: Column) -> Column:
    """True for keys in the engine's own name spaces."""
    hit = key.isin(*RESERVED_KEYS)
    for prefix in RESERVED_PREFIXES:
        hit = hit | key.startswith(prefix)
    return hit


def check_user_key(key: str) -> None:
    if not key:
        raise ValueError("a key may not be empty")
    if key in RESERVED_KEYS or key.startswith(RESERVED_PREFIXES):
        raise ValueError(f"{key!r} is in a reserved name space")


def events_changelog(events: DataFrame) -> DataFrame:
    """The events table read as a change log: a user's events are versions, errors are deletions."""
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("value").cast("string").alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("tombstone"),
    )
