"""The change log as a stream: a file source feeds level 0 of a store, once per batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequential import bucket_steps
from ..schema import KV_SCHEMA
from ..sources.files import Files
from ..sources.store import KVStore


def read_stream(spark: SparkSession, path: str, schema: T.StructType = KV_SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_stream(log: DataFrame, store: KVStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch as a run. The manifest keeps the last batch of each stream, named by the id in its checkpoint, so a batch replayed after a failure is
    skipped while other streams, or this one under a new checkpoint, count on their own."""
    files = Files(store.spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(files.read(f"{checkpoint}/metadata"))["id"]
        if store.manifest()["offsets"].get(stream, -1) < batch_id and not batch.isEmpty():
            store.append(batch, stream, batch_id)

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def limit_stream(requests: DataFrame, capacity: int, reset_ms: int, entity: str = "key", time_us: str = "ts_us") -> DataFrame:
    """The token bucket over a stream, with (tokens, since) as state per entity; adds ``allowed`` and ``tokens_left``. An entity's rows of a micro-batch are put in
    order of time before they are judged, so an entity's rows of one micro-batch must fit in memory; rows that come later than newer ones
    are judged when they come. A null time is refused."""
    clash = {c.lower() for c in requests.columns} & {"allowed", "tokens_left"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, since = state.get if state.exists else (capacity, None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(time_us, kind="stable").reset_index(drop=True)  # chunks are in no order
        known = pdf[time_us].notna().to_numpy()
        times = pdf[time_us].fillna(0).to_numpy().astype(np.int64)
        allowed, left, tokens, since = bucket_steps(times, known, capacity, reset_ms * 1000, tokens, since)
        state.update((tokens, since))
        yield pdf.assign(allowed=allowed, tokens_left=left)

    return requests.groupBy(entity).applyInPandasWithState(run, f"{whole}, allowed boolean, tokens_left int", "tokens int, since long", "append", "NoTimeout")
