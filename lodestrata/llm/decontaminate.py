"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space runs become one space. Test items longer than two units are cut into units of at least ``unit_chars``; a
unit of n characters allows k = n * rate edits and is cut into k + 1 pieces, one of which any match within k edits must hold unchanged. A unit too short
for an edit must be found between word borders, so that a short item is not found inside words; where such an item is a common word, it is found as often. An
Aho-Corasick automaton finds all piece hits in a whole document; around each the window is verified with Myers' bit-parallel distance.

Documents are not shuffled: the automaton goes to them. It is built from blocks of items of bounded size; a larger test set takes several passes
over the documents, one per block.

Defined cases: null or empty documents match nothing, as do items without a letter or digit; repeated items or documents are matched each; a null
doc_id is carried through; an empty test set gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_slices

RATE = 0.08
UNIT_CHARS = 120
BLOCK_BYTES = 8 << 20
SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, item_id long, unit int, distance int, start long, end long"


def normal(text: str) -> str:
    return SPACE.sub(" ", text.lower()).strip(" ")


def units(text: str, unit_chars: int = UNIT_CHARS) -> list[str]:
    """The whole text, or pieces of equal length of at least ``unit_chars``."""
    n = max(1, len(text) // unit_chars)
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


def pieces(unit: str, k: int) -> list[tuple[int, str]]:
    """The unit cut into k + 1 parts with their places."""
    cut = [len(unit) * i // (k + 1) for i in range(k + 2)]
    return [(a, unit[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def myers(pattern_bits: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` where the pattern ends within k edits, the first of equals; None if there is none."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    limit = k
    for at, ch in enumerate(text):
        eq = pattern_bits.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= limit:
            best, limit = (score, at + 1), score - 1
            if limit < 0:
                break
    return best


def _inside(text: str, start: int, end: int) -> bool:
    """Whether a word goes on beyond either end."""
    word = lambda c: c.isalnum() or c == "_"
    return start > 0 and word(text[start - 1]) and word(text[start]) or end < len(text) and word(text[end]) and word(text[end - 1])


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, unit_chars: int = UNIT_CHARS):
        import ahocorasick

        self.units: list[tuple[int, int, str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            for no, unit in enumerate(units(normal(text), unit_chars)):
                if not re.search(r"\w", unit):
                    continue
                k = int(len(unit) * rate)
                for at, piece in pieces(unit, k):
                    places.setdefault(piece, []).append((len(self.units), at))
                self.units.append((item, no, unit, k))
        self.bits: dict[int, dict[str, int]] = {}
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton()
            for piece, where in places.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()

    def _pattern(self, u: int) -> dict[str, int]:
        if u not in self.bits:
            self.bits[u] = {}
            for i, ch in enumerate(self.units[u][2]):
                self.bits[u][ch] = self.bits[u].get(ch, 0) | 1 << i
        return self.bits[u]

    def match(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, unit, distance, start, end) of the best match of every unit in the normalised text; start is where a window of the unit's
        length would begin."""
        if self.automaton is None or not text:
            return []
        hits: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for u, at in where:
                if self.units[u][3] or not _inside(text, end + 1 - length, end + 1):
                    hits.setdefault(u, []).append(end + 1 - length - at)
        found = []
        for u, starts in hits.items():
            item, no, unit, k = self.units[u]
            best, done = None, -1
            starts.sort()
            at = 0
            while at < len(starts):
                first = last = starts[at]
                while at < len(starts) and starts[at] <= last + 2 * k + 1:  # windows that overlap are one
                    last = starts[at]
                    at += 1
                low, high = max(0, first - k), last + len(unit) + k
                got = myers(self._pattern(u), len(unit), text[low:high], k if best is None else best[0] - 1) if high - low >= len(unit) - k else None
                if got:
                    best = (got[0], low + got[1])
                    if not best[0]:
                        break
            if best:
                found.append((item, no, best[0], max(0, best[1] - len(unit)), best[1]))
        return found


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, unit_chars: int = UNIT_CHARS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, item and matched unit: doc_id, item_id, unit, distance, start, end (characters of the normalised text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = docs.sparkSession.sparkContext.broadcast
    return reduce(DataFrame.unionByName, [_pass(docs, share(block), rate, unit_chars) for block in item_blocks(benchmark, block_bytes)])


def _matcher(key: str, items, rate: float, unit_chars: int) -> Matcher:
    """One per Python worker, kept between tasks."""
    return keep(("matcher", key), lambda: Matcher(items.value, rate, unit_chars))


def _pass(docs: DataFrame, items, rate: float, unit_chars: int) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, rate, unit_chars)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for part in text_slices(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    rows.extend((doc, *m) for m in matcher.match(normal(text)))
            if rows:
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, unit_chars: int = UNIT_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept. The automaton filters the rows where they are, so there is no join."""
    for block in item_blocks(benchmark, block_bytes):
        docs = _clean(docs, docs.sparkSession.sparkContext.broadcast(block), rate, unit_chars)
    return docs


def _clean(docs: DataFrame, items, rate: float, unit_chars: int) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, rate, unit_chars)
        for part in text_slices(batches):
            keep = [not (text and matcher.match(normal(text))) for text in part.column("text").to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
