"""A levelled key-value store over Parquet.

Single writes go to a write-ahead log and a table in memory; ``run_rows`` of them become a run, as does every DataFrame that is appended. Runs are immutable
folders, dealt and sorted by key (so row-group bounds and Parquet's own key filters prune point reads). One small manifest names the live runs
with their key bounds; a change writes new runs first, then replaces the manifest, then deletes what it no longer names, so a job that dies
part way leaves the store as it was. One writer at a time; readers see the manifest they began with. A deletion is forgotten once no run can hold an
older version; one that is written later still, with an older time, then counts as new.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, latest, merkle, scan
from ..operators.sequential import Recent
from ..schema import KV_SCHEMA, EngineOptions, check_user_key
from .codec import Entry
from .files import Files
from .wal import WriteAheadLog

COLUMNS = [c.name for c in KV_SCHEMA.fields]
MEMORY = -1  # the level of what is not yet in a run


class KVStore:
    def __init__(self, spark: SparkSession, base: str, options: EngineOptions | None = None):
        self.spark, self.base, self.options = spark, base.rstrip("/"), options or EngineOptions()
        self.files = Files(spark, self.base)
        if not self.files.exists(f"{self.base}/manifest.json"):
            self._publish({"next": 0, "seq": 0, "runs": [], "offsets": {}, "wal": [1, 0]})
        self.wal = WriteAheadLog(spark, f"{self.base}/wal", self.options.block_size, self.options.segment_blocks)
        self.recent, self._seen = Recent(self.options.cache_size), None
        self.memory: dict[str, tuple] = {}
        self._recover()

    # -- manifest -----------------------------------------------------------------------------------------------

    def manifest(self) -> dict:
        return json.loads(self.files.read(f"{self.base}/manifest.json"))

    def _publish(self, state: dict) -> None:
        self.files.replace(f"{self.base}/manifest.json", json.dumps(state).encode())

    def _run_path(self, level: int, generation: int) -> str:
        return f"{self.base}/level={level}/generation={generation}"

    def _drop_run(self, run: dict) -> None:
        self.files.delete(self._run_path(run["level"], run["generation"]))
        self.files.delete(f"{self.base}/merkle/generation={run['generation']}")

    # -- writes -------------------------------------------------------------------------------------------------

    def _write_run(self, rows: DataFrame, level: int, generation: int, keys: int | None = None) -> dict | None:
        """Writes a run and says what it holds; None if that is nothing. The key filters are sized for ``keys``, or by what Parquet finds."""
        path, files = self._run_path(level, generation), max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        out = rows.select(COLUMNS).repartitionByRange(files, "key").sortWithinPartitions("key", "ts", "seq").write.mode("overwrite")
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_fp))
        out = out.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-keys // files)))) if keys else out.option("parquet.bloom.filter.adaptive.enabled", "true")
        out.parquet(path)
        found = self.spark.read.schema(KV_SCHEMA).parquet(path).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"), F.approx_count_distinct("key").alias("keys"), F.max("seq").alias("seq")).first()
        if not found["rows"]:
            self.files.delete(path)
            return None
        return {"level": level, "generation": generation, **found.asDict()}

    def append(self, log: DataFrame, stream: str | None = None, offset: int | None = None) -> int:
        """A change-log batch becomes one run of level 0; returns its generation. ``stream`` and ``offset`` are kept in the manifest with it."""
        state = self.manifest()
        run = self._write_run(log, 0, state["next"])
        return self._add(state, run, {stream: offset} if stream else {}, {})

    def _add(self, state: dict, run: dict | None, offsets: dict, more: dict) -> int:
        g = state["next"]
        if run:
            state["runs"].append(run)
            state["seq"] = max(state["seq"], run["seq"] + 1)
            self._next_seq = max(self._next_seq, state["seq"])
        self._publish(state | {"next": g + 1, "offsets": state["offsets"] | offsets} | more)
        if run and self.options.trees:
            self.save_merkle(g)
        self.compact(0)
        return g

    def _one(self, key: str, value: str | None, tombstone: bool, ts: int | None) -> None:
        ts = int(time.time() * 1e6) if ts is None else ts
        self.wal.append(Entry(key.encode(), (value or "").encode(), ts, tombstone))
        self._remember(key, value, ts, tombstone)
        self.recent.kept.pop(key, None)
        if len(self.memory) >= self.options.run_rows:
            self.flush()

    def _remember(self, key: str, value: str | None, ts: int, tombstone: bool) -> None:
        self._next_seq += 1
        row = (key, value, ts, self._next_seq - 1, tombstone)
        if key not in self.memory or row[2:4] > self.memory[key][2:4]:
            self.memory[key] = row

    def _recover(self) -> None:
        """What the log holds beyond the last flush is in memory again."""
        state = self.manifest()
        self.memory, self._next_seq = {}, state["seq"]
        for e in self.wal.read(tuple(state["wal"])):
            self._remember(e.key.decode(), None if e.tombstone else e.value.decode(), e.ts, e.tombstone)

    def flush(self) -> int | None:
        """The writes in memory become a run of level 0, sorted by key; returns its generation, None if there are none."""
        if not self.memory:
            return None
        state, at = self.manifest(), self.wal.rotate()
        run = self._write_run(self._memory_rows(), 0, state["next"], len(self.memory))
        self.memory = {}
        g = self._add(state | {"seq": max(state["seq"], self._next_seq)}, run, {}, {"wal": list(at)})
        self._next_seq = max(self._next_seq, self.manifest()["seq"])
        self.wal.truncate(at)
        return g

    def _memory_rows(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.memory.values()), KV_SCHEMA)

    def put(self, key: str, value: str, ts: int | None = None) -> None:
        check_user_key(key)
        if not value:
            raise ValueError("a value may not be empty")
        self._one(key, value, False, ts)

    def delete(self, key: str, ts: int | None = None) -> None:
        """A tombstone; deleting an absent key succeeds."""
        check_user_key(key)
        self._one(key, None, True, ts)

    def system_put(self, key: str, value: str, ts: int | None = None) -> None:
        """Writes to the engine's own name spaces."""
        self._one(key, value, False, ts)

    def system_delete(self, key: str, ts: int | None = None) -> None:
        self._one(key, None, True, ts)

    # -- reads --------------------------------------------------------------------------------------------------

    def log(self, level: int | None = None) -> DataFrame:
        """All versions with the level and generation they lie in; those still in memory are of level -1."""
        runs = [(r["level"], r["generation"]) for r in self.manifest()["runs"] if level is None or r["level"] == level]
        frames = [self.spark.read.schema(KV_SCHEMA).parquet(self._run_path(n, g)).withColumns({"level": F.lit(n), "generation": F.lit(g).cast("bigint")}) for n, g in runs]
        if not frames or level in (None, MEMORY) and self.memory:
            rows = self._memory_rows() if level in (None, MEMORY) else self.spark.createDataFrame([], KV_SCHEMA)
            frames.append(rows.withColumns({"level": F.lit(MEMORY), "generation": F.lit(None).cast("bigint")}))
        return reduce(DataFrame.unionByName, frames)

    def live(self) -> DataFrame:
        return latest.live(self.log())

    def get(self, key: str) -> tuple[str, int] | None:
        """The value and the level it was found in, or None. The last ``cache_size`` keys asked for are answered from memory while the runs stay the same."""
        state = self.manifest()
        if self._seen != (state["next"], len(state["runs"])):
            self.recent.clear()
            self._seen = (state["next"], len(state["runs"]))
        known, found = self.recent.get(key)
        if not known:
            row = latest.point_get(self.log(), key).first()
            found = (row["value"], row["level"]) if row else None
            self.recent.put(key, found)
        return found

    def prefix_scan(self, prefix: str, number: int, size: int) -> DataFrame:
        return scan.prefix_scan(self.log(), prefix, number, size)

    def range_scan(self, low: str, high: str, number: int, size: int) -> DataFrame:
        return scan.range_scan(self.log(), low, high, number, size)

    def bounds(self) -> DataFrame:
        return compaction.run_bounds(self.log())

    # -- compaction and integrity -------------------------------------------------------------------------------

    def compact(self, level: int) -> None:
        """Once a level has ``merge_threshold`` runs they are merged into the next level (the same one at the bottom), and that one is looked at in turn. Size-tiered:
        all of them become one more run there. Leveled: the runs they reach into are merged with them, so that a level's runs stay apart."""
        while sum(r["level"] == level for r in self.manifest()["runs"]) >= self.options.merge_threshold:
            self.merge_level(level)
            level += 1
            if level >= self.options.max_levels:
                return

    def merge_level(self, level: int) -> None:
        state = self.manifest()
        target = min(level + 1, self.options.max_levels - 1)
        if self.options.compaction == "leveled":
            taken = compaction.leveled_inputs(state["runs"], level, target)
        else:
            taken = [r for r in state["runs"] if r["level"] == level]
        if not taken:
            return
        rest = [r for r in state["runs"] if r not in taken]
        low, high = min(r["low"] for r in taken), max(r["high"] for r in taken)
        frames = [self.spark.read.schema(KV_SCHEMA).parquet(self._run_path(r["level"], r["generation"])) for r in taken]
        # tombstones go only if no other run can hold an older version
        merged = compaction.merge_runs(frames, bottom=not compaction.overlapping(rest, low, high))
        g = state["next"]
        run = self._write_run(merged, target, g, sum(r["keys"] for r in taken))
        self._publish(state | {"next": g + 1, "runs": rest + ([run] if run else [])})
        if run and self.options.trees:
            self.save_merkle(g)
        for r in taken:
            self._drop_run(r)

    def merkle(self, generation: int) -> DataFrame:
        run = self.log().filter(F.col("generation") == generation)
        return merkle.build(merkle.leaves(run, payload_of(run)))

    def save_merkle(self, generation: int) -> None:
        self.merkle(generation).write.mode("overwrite").parquet(f"{self.base}/merkle/generation={generation}")

    def validate(self, generation: int, level: int | None = 0) -> DataFrame:
        """Leaves of a run (nodes of all levels for None) that differ from the tree stored for it; no rows if it is intact."""
        stored = self.spark.read.parquet(f"{self.base}/merkle/generation={generation}")
        return merkle.diff(stored, self.merkle(generation), level)

    def clear(self) -> None:
        """Removes every run with its tree, what is in memory and the log."""
        state = self.manifest()
        self.memory, at = {}, self.wal.rotate()
        self.recent.clear()
        self._publish(state | {"runs": [], "offsets": {}, "wal": list(at)})
        for r in state["runs"]:
            self._drop_run(r)
        self.files.delete(f"{self.base}/merkle")
        self.wal.truncate(at)


def payload_of(df: DataFrame):
    """The bytes a leaf hash covers: every field, in text, with a separator no key holds."""
    parts = [F.col("key"), F.col("ts").cast("string"), F.col("tombstone").cast("string"), F.coalesce(F.col("value"), F.lit(""))]
    return F.encode(F.concat_ws("\u0001", *parts), "utf-8")
