"""Operators with sequential state: the token bucket and the LRU cache.

Both depend on every earlier row of the same entity, so rows are dealt by entity, sorted inside, and walked in Arrow batches, column by column. State is
a few numbers (bucket) or ``capacity`` keys (cache), whatever the entity's history. An entity's rows are one task's work by nature: no
later decision can be made without the earlier ones.

Defined cases: null entities are one entity, as are NaN ones; a row without a time is refused and changes nothing; an empty table gives no rows; a
column named like one that is added is an error.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column begins a new value; nulls are alike, NaNs too."""
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False)
    differ = pc.or_(differ, pc.xor(a.is_null(), b.is_null()))
    if pa.types.is_floating(column.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def _walk(df: DataFrame, entity: str, order: list[str], make: Callable, added: str) -> DataFrame:
    """Feeds the rows of each entity in order to a fresh state, a run of rows at a time; a task holds one batch and the current state only."""
    names = [x.split()[0] for x in added.split(", ")]
    clash = {c.lower() for c in df.columns} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            same = last is not None and not len(_changes(pa.concat_arrays([last, column[:1]])))
            cuts = [0, *_changes(column).tolist(), batch.num_rows]
            out = []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i or not same:
                    state = make()
                out.append(state(batch.slice(a, b - a)))
            last = column[-1:]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.concat_arrays([o[j] for o in out]) for j in range(len(names))]], [*batch.schema.names[1:], *names])

    dealt = df.withColumn("__entity", F.col(entity)).select("__entity", *df.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {added}"
    return dealt.repartition("__entity").sortWithinPartitions("__entity", *order).mapInArrow(run, schema)


def bucket_steps(times: np.ndarray, known: np.ndarray, capacity: int, reset_us: int, tokens: int, since: int | None) -> tuple[np.ndarray, np.ndarray, int, int | None]:
    """Decisions for rows in time order, and the state after them. One step per refill: up to the next one the first ``tokens`` rows are allowed."""
    allowed, left = np.zeros(len(times), bool), np.zeros(len(times), np.int32)
    at = np.flatnonzero(known)
    t, i = times[at], 0
    ok, rest = np.zeros(len(t), bool), np.zeros(len(t), np.int32)
    while i < len(t):
        if since is None:
            since = int(t[i])
        elif t[i] - since >= reset_us:
            tokens, since = capacity, int(t[i])
        end = max(i + 1, int(np.searchsorted(t, since + reset_us)))
        many = np.arange(1, end - i + 1)
        ok[i:end], rest[i:end] = many <= tokens, np.maximum(tokens - many, 0)
        tokens, i = max(tokens - (end - i), 0), end
    allowed[at], left[at] = ok, rest
    return allowed, left, tokens, since


def token_bucket(requests: DataFrame, capacity: int, reset_ms: int, entity: str = "key", time_us: str = "ts_us", order: list[str] | None = None) -> DataFrame:
    """Adds ``allowed`` and ``tokens_left``. The bucket starts full; once ``reset_ms`` have passed since the last refill it is filled up whole (never in
    proportion), and each allowed request takes one token. ``order`` begins with the time."""
    order = order or [time_us]
    if order[0] != time_us:
        raise ValueError("requests are taken in order of time")

    def make() -> Callable:
        tokens, since = capacity, None

        def step(rows: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
            nonlocal tokens, since
            t = rows.column(time_us)
            allowed, left, tokens, since = bucket_steps(pc.fill_null(t, 0).to_numpy(zero_copy_only=False), t.is_valid().to_numpy(zero_copy_only=False), capacity, reset_ms * 1000, tokens, since)
            return pa.array(allowed), pa.array(left)

        return step

    return _walk(requests, entity, order, make, "allowed boolean, tokens_left int")


class Recent:
    """The ``capacity`` most recently used keys with their values. A removed key stays known as absent, so that asking for it again needs no search."""

    def __init__(self, capacity: int):
        self.capacity, self.kept = capacity, OrderedDict()

    def get(self, key) -> tuple[bool, object]:
        """Whether the key is known, and its value, None where it is known to be absent."""
        if key not in self.kept:
            return False, None
        self.kept.move_to_end(key)
        return True, self.kept[key]

    def put(self, key, value=True) -> None:
        self.kept[key] = value
        self.kept.move_to_end(key)
        if len(self.kept) > self.capacity:
            self.kept.popitem(last=False)

    def remove(self, key) -> None:
        if key in self.kept:
            self.kept[key] = None

    def clear(self) -> None:
        self.kept.clear()


def lru_simulation(accesses: DataFrame, capacity: int, entity: str = "cache", key: str = "key", order: list[str] | None = None, op: str | None = None) -> DataFrame:
    """Adds ``hit``: whether the key was among the ``capacity`` most recently used of its cache. Every access puts its key; with a column ``op`` of
    get, put and remove, a get that misses puts nothing, and a removed key hits as absent until it is put again or leaves."""

    def make() -> Callable:
        kept = Recent(capacity)

        def step(rows: pa.RecordBatch) -> tuple[pa.Array]:
            keys, out = rows.column(key).to_pylist(), []
            for k, o in zip(keys, rows.column(op).to_pylist() if op else ["access"] * len(keys), strict=True):
                out.append(kept.get(k)[0])
                if o in ("access", "put"):
                    kept.put(k)
                elif o == "remove":
                    kept.remove(k)
            return (pa.array(out, pa.bool_()),)

        return step

    return _walk(accesses, entity, order or ["seq"], make, "hit boolean")
