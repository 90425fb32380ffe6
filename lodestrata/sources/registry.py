"""Named sketch instances: create, add, query, delete. Each change is a new version in a KVStore under a reserved prefix."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, countmin, hll
from ..operators.simhash import fingerprints
from .store import KVStore

# The prefix of each kind.
PREFIX = {"bloom": "bf_", "countmin": "cms_", "hll": "hpp_", "simhash": "sh_"}
STATES = {"bloom": bloom.BloomState, "countmin": countmin.CountMinState, "hll": hll.HllState}


class SketchRegistry:
    def __init__(self, store: KVStore):
        self.store = store
        self.spark: SparkSession = store.spark

    def _load(self, kind: str, name: str):
        found = self.store.get(PREFIX[kind] + name)
        if not found:
            raise KeyError(f"no {kind} named {name!r}")
        data = base64.b64decode(found[0])
        return STATES[kind].from_bytes(data) if kind in STATES else data

    def _save(self, kind: str, name: str, data: bytes) -> None:
        self.store.system_put(PREFIX[kind] + name, base64.b64encode(data).decode())

    def create_bloom(self, name: str, n: int, fp: float) -> None:
        self._save("bloom", name, bloom.BloomState(*bloom.parameters(n, fp)).to_bytes())

    def create_countmin(self, name: str, epsilon: float, delta: float) -> None:
        self._save("countmin", name, countmin.CountMinState(*countmin.parameters(epsilon, delta)).to_bytes())

    def create_hll(self, name: str, p: int) -> None:
        self._save("hll", name, hll.HllState(p).to_bytes())

    def create_simhash(self, name: str, text: str) -> str:
        row = fingerprints(self.spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
        print_ = row["fingerprint"] if row else "0" * 32
        self._save("simhash", name, bytes.fromhex(print_))
        return print_

    def delete(self, kind: str, name: str) -> None:
        self.store.system_delete(PREFIX[kind] + name)

    def add(self, kind: str, name: str, items: DataFrame, column: str) -> None:
        """Aggregates on the cluster to at most one row per cell of the sketch, then merges those into the stored state."""
        s = self._load(kind, name)
        if kind == "bloom":
            s.set_bits(r["bit"] for r in bloom.build(items, column, s.m, s.k, s.seed).toLocalIterator())
        elif kind == "countmin":
            s.add(tuple(r) for r in countmin.build(items, column, s.m, s.k, s.seed).select("row", "bucket", "cnt").toLocalIterator())
        elif kind == "hll":
            s.update(tuple(r) for r in hll.registers(items, column, s.p).select("bucket", "rank").toLocalIterator())
        else:
            raise ValueError(f"nothing can be added to a {kind}")
        self._save(kind, name, s.to_bytes())

    def contains(self, name: str, item: str) -> bool:
        s = self._load("bloom", name)
        one = self.spark.createDataFrame([(item,)], "x string")
        return s.has_bits(one.select(bloom.bits_of(F.col("x"), s.m, s.k, s.seed).alias("b")).first()["b"])

    def frequency(self, name: str, item: str) -> int:
        s = self._load("countmin", name)
        one = self.spark.createDataFrame([(item,)], "x string")
        return s.query([tuple(c) for c in one.select(countmin.cells_of(F.col("x"), s.m, s.k, s.seed).alias("c")).first()["c"]])

    def cardinality(self, name: str) -> float:
        s = self._load("hll", name)
        rows = [(i, r) for i, r in enumerate(s.regs) if r]
        return hll.estimate(self.spark.createDataFrame(rows, "bucket long, rank int"), s.p).first()["estimate"]

    def distance(self, a: str, b: str) -> int:
        x, y = self._load("simhash", a), self._load("simhash", b)
        return (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()
