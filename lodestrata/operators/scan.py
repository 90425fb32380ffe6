"""Ordered scans over the live state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .latest import live


def prefix_rows(log: DataFrame, prefix: str) -> DataFrame:
    """Live rows whose key starts with ``prefix`` (all rows for an empty one)."""
    return live(log.filter(F.startswith(F.col("key"), F.lit(prefix))) if prefix else log)


def range_rows(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live rows with low <= key <= high in byte order; none if low > high."""
    return live(log.filter(F.col("key").between(low, high)))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in key order; beyond the end it is empty."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


def prefix_scan(log: DataFrame, prefix: str, number: int, size: int) -> DataFrame:
    return page(prefix_rows(log, prefix), number, size)


def range_scan(log: DataFrame, low: str, high: str, number: int, size: int) -> DataFrame:
    return page(range_rows(log, low, high), number, size)


def floor_key(log: DataFrame, key: str) -> DataFrame:
    """The greatest live key that is not above ``key``; null if there is none."""
    return live(log.filter(F.col("key") <= key)).agg(F.max("key").alias("key"))


class SortedIterator:
    """A cursor in key order that pulls one partition at a time; stop() ends it until reset()."""

    def __init__(self, rows: DataFrame):
        self._rows = rows.orderBy("key")
        self.reset()

    def reset(self) -> None:
        self._stopped = False
        self._it: Iterator[Row] = self._rows.toLocalIterator()
        self._ahead = next(self._it, None)

    def stop(self) -> None:
        self._stopped, self._ahead, self._it = True, None, iter(())

    def has_next(self) -> bool:
        return not self._stopped and self._ahead is not None

    def next(self) -> Row | None:
        row = self._ahead if self.has_next() else None
        if row is not None:
            self._ahead = next(self._it, None)
        return row

    def __iter__(self) -> Iterator[Row]:
        while self.has_next():
            yield self.next()


def prefix_iterate(log: DataFrame, prefix: str) -> SortedIterator:
    return SortedIterator(prefix_rows(log, prefix))


def range_iterate(log: DataFrame, low: str, high: str) -> SortedIterator:
    return SortedIterator(range_rows(log, low, high))
