"""Repeated passages by collinear chaining of shared seeds.

Seeds are hashes of ``K`` words chosen by winnowing: of every ``WINDOW`` places the least hash, so any repeat of K + WINDOW - 1 words holds one. A seed
found in several documents links each of its places to its first one (least document, then place), never places with one another. The links of
two documents are merged along diagonals into anchors, and anchors are chained in order in both texts: a chain's score is the words it covers less
a cost for each word of a gap, found with a Fenwick tree of prefix maxima. Chains are cut at long gaps, their words fetched from both texts,
grown at both ends past words that differ, and aligned. Passages of ``MIN_WORDS`` or more at identity ``MIN_IDENTITY`` or more are returned. A passage whose
copies differ has to share a seed: that holds for nearly all at identity 0.95 and for fewer below (README).

A line that is repeated in a text gives the same seeds in every round; later rounds have their number hashed in and meet round by round, so a text of many rounds
is one chain with the first that has as many. Where that finds no passage, a round is linked to the first place of its seed like any other.

The first place of a seed may share no passage with two later ones that share one with each other. So places meet again under their seed and the words
behind the ends of what they share with the first place (``relink``), and again under longer and longer keys, until none meet.

First places of single seeds can lie in documents that share too little, while two later documents share a whole passage. So every window of
``MIN_WORDS`` words that the seeds leave possible is looked at again, by the hash of all of its words: windows that are equal are linked to the first of
them, which has the whole window, so no exact repeat of ``MIN_WORDS`` words is lost. Windows in exact passages whose seeds all link to that passage are
left out: wherever else such a window is, its seeds link it to the same first one.

A seed in very many documents is one row in the aggregation of each task and a hot key of a join that Spark splits. Chains of a pair of documents need
no more memory than their texts' seeds; requests for words of one document are dealt in groups of bounded size.

Defined cases: null texts, and texts shorter than K words, have no seeds; a null id takes no part; rows that share an id are one document, places taken
from each, and aligned with one of them; passages repeated only inside one document are not reported; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_slices, word_hashes, words_of
from .lm import U, mix64
from .near_dedup import FILTER_BITS, id_filter

K, WINDOW = 8, 12
MIN_WORDS, MIN_IDENTITY = 50, 0.8
MAX_GAP = 64
GAP_COST = 0.25
FLANK = 48
ASK = 4096
STEP = U(0x9E3779B97F4A7C15)
SIDES = (U(0x51A7C3D2E4B69F08), U(0xC2B2AE3D27D4EB4F))  # set keys to the right and left apart


def seeds_of(text: pa.Array, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, word place) of the chosen seeds, in order. Where one word is repeated all seeds are alike, so there every ``k``-th is kept and its
    distance from the beginning of the run is hashed in: such runs then match place by place. Where a line is repeated, a seed that comes again has the number of
    its round hashed in. The same places come again as -1 - place with the hash of the run, or the seed's, alone, which tells that a run or seed like it is elsewhere."""
    starts, codes, words = words_of(text, lower=True)
    many = np.maximum(np.diff(starts) - k + 1, 0)
    if not many.sum():
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    h = word_hashes(words)[codes]
    doc = np.repeat(np.arange(len(many)), many)
    ends = np.cumsum(many)
    place = np.arange(ends[-1]) - np.repeat(ends - many, many)
    at = np.repeat(starts[:-1], many) + place
    grams = np.zeros(len(at), U)
    for j in range(k):
        grams = mix64(grams * STEP + h[at + j])
    chosen = np.zeros(len(grams), bool)
    if len(grams) >= window:
        view = np.lib.stride_tricks.sliding_window_view(grams, window)
        inside = np.flatnonzero(doc[: len(view)] == doc[window - 1 :])
        for x in range(0, len(inside), 1 << 18):
            part = inside[x : x + (1 << 18)]
            chosen[part + view[part].argmin(axis=1)] = True
    short = np.flatnonzero((many > 0) & (many < window))
    for i in short:
        a = ends[i] - many[i]
        chosen[a + grams[a : ends[i]].argmin()] = True
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])))
    run = np.arange(len(grams)) - np.maximum.accumulate(np.where(fresh, np.arange(len(grams)), 0))
    chosen &= run % k == 0
    inner = chosen & (run > 0)
    own, at, key = doc[chosen], place[chosen], np.where(run > 0, mix64(grams + run.astype(U) * STEP), grams)[chosen]
    round_ = rounds(own, key, at)
    again = round_ > 0
    return (
        np.concatenate((own, own[again], doc[inner])), np.concatenate((np.where(again, mix64(key + round_.astype(U) * STEP), key), key[again], mix64(~grams[inner]))),
        np.concatenate((at, -1 - at[again], -1 - place[inner])),
    )


def rounds(doc: np.ndarray, key: np.ndarray, place: np.ndarray, reach: int = MAX_GAP) -> np.ndarray:
    """How many times in a row a text has had the key before, each time at most ``reach`` words after the last."""
    order = np.lexsort((place, key, doc))
    d, h, p = doc[order], key[order], place[order]
    n = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = n - np.maximum.accumulate(np.where(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (p[1:] - p[:-1] > reach))), n, 0)) if len(n) else n
    return out


def window_hashes(h: np.ndarray, size: int = MIN_WORDS) -> np.ndarray:
    """Hashes of the ``size`` words from each place on, one row for each place that has so many behind it."""
    out, done, power, length = None, 0, h, 1
    n = len(h) - size + 1
    while done < size:
        if size & length:
            part = power[done : done + n]
            out = part if out is None else mix64(out * STEP + part)
            done += length
        power = mix64(power[:-length] * STEP + power[length:])
        length *= 2
    return out


def open_windows(pos: np.ndarray, other: np.ndarray, diagonal: np.ndarray, runs: list[tuple[int, int, int, int]], size: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Ranges of places, end exclusive, at which a window repeated elsewhere may begin: of one document's seeds found in several documents, none is
    missing for long, and not all link to one of the exact ``runs`` (start, end, other, diagonal) that holds the window. A place below 0
    stands for a run of one word."""
    plain = pos >= 0
    pos = np.where(plain, pos, -1 - pos)
    order = np.argsort(pos, kind="stable")
    pos, other, diagonal, plain = pos[order], other[order], diagonal[order], plain[order]
    slack, last = WINDOW + K, size - K
    cuts = np.flatnonzero(np.diff(pos) > slack) + 1
    out = [(max(0, f - slack), l - last + slack + 1) for f, l in zip(pos[np.concatenate(([0], cuts))].tolist(), pos[np.concatenate((cuts - 1, [len(pos) - 1]))].tolist(), strict=True)]
    out = [(a, b) for a, b in out if a < b]
    if not out or not runs:
        return out
    new = np.flatnonzero((other[1:] != other[:-1]) | (diagonal[1:] != diagonal[:-1]) | ~plain[1:] | ~plain[:-1]) + 1
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for start, end, oth, dia in runs:
        by.setdefault((oth, dia), []).append((start, end))
    known = []
    for i, j in zip([0, *new.tolist()], [*new.tolist(), len(pos)], strict=True):
        for start, end in by.get((int(other[i]), int(diagonal[i])), ()) if plain[i] else ():
            low, high = max(start, int(pos[i - 1]) + 1 if i else 0), min(end - size, int(pos[j]) - last - 1 if j < len(pos) else end) + 1
            if low < high:
                known.append((low, high))
    known.sort()
    left, k = [], 0
    for a, b in out:
        while k < len(known) and known[k][1] <= a:
            k += 1
        for low, high in known[k:]:
            if low >= b:
                break
            if low > a:
                left.append((a, low))
            a = max(a, high)
        if a < b:
            left.append((a, b))
    return left


def cover(found: list[list[int]]) -> list[list[int]]:
    """As few of the anchors as hold every word of the first text that any of them holds."""
    out: list[list[int]] = []
    best = None
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if best is not None and x[0] > (out[-1][1] if out else -1):
            if best[1] > (out[-1][1] if out else -1):
                out.append(best)
            best = None
        if best is None or x[1] > best[1]:
            best = x
    if best is not None and (not out or best[1] > out[-1][1]):
        out.append(best)
    return out


def anchors(pos: np.ndarray, other: np.ndarray, k: int = K, reach: int = K + WINDOW) -> list[list[int]]:
    """Links on one diagonal that follow closely become one anchor: start, end, other start, other end, words covered."""
    order = np.lexsort((pos, pos - other))
    out: list[list[int]] = []
    last = None
    for p, c in zip(pos[order].tolist(), other[order].tolist(), strict=True):
        if last is not None and p - c == last[0] - last[2] and p <= last[1] + reach:
            last[4] += max(0, p + k - max(p, last[1]))
            last[1], last[3] = max(last[1], p + k), max(last[3], c + k)
        else:
            last = [p, p + k, c, c + k, k]
            out.append(last)
    return sorted(out)


def chains(found: list[list[int]], cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[list[int]]]:
    """Best chains of anchors in order in both texts, each anchor in one chain at most.

    With a gap cost linear in both texts, the best chain before an anchor is a prefix maximum over other-text ends, less a term of the anchor itself; a
    Fenwick tree keeps these maxima while anchors come in order of the first text.
    """
    n = len(found)
    if n == 1:
        return [found]
    ends = sorted({a[3] for a in found})
    rank = {e: i + 1 for i, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    score, back = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: found[i][1])
    done = 0
    for i, (start, _, ostart, _, words) in enumerate(found):
        while done < n and found[waiting[done]][1] <= start + K // 2:  # a slight overlap is allowed
            j = waiting[done]
            if j >= i:
                break
            value, at = (score[j] + cost * (found[j][1] + found[j][3]), j), rank[found[j][3]]
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
            done += 1
        at, best = _floor(ends, ostart + K // 2), (-1e18, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - cost * (start + ostart)
        score[i] = words + max(0.0, gain)
        back[i] = best[1] if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        chain.reverse()
        part: list[list[int]] = []
        for a in chain:
            if part and max(a[0] - part[-1][1], a[2] - part[-1][3]) > max_gap:
                out.append(part)
                part = []
            part.append(a)
        if part:
            out.append(part)
    return out


def _floor(ends: list[int], x: int) -> int:
    import bisect

    return bisect.bisect_right(ends, x)


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two word sequences, bit-parallel over the first."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    if n:
        same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return max(len(x), len(y))
    bits: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        bits[w] = bits.get(w, 0) | 1 << i
    mask, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    pv, mv, score = mask, 0, len(x)
    for w in y.tolist():
        eq = bits.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return score


# How far both texts go on at words that differ, the nearest first: replaced, missing and added words, up to three.
MOVES = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (3, 3))


def grow(x: np.ndarray, y: np.ndarray, i: int, j: int, step: int, sure: int = 2) -> tuple[int, int]:
    """Moves both ends on while words agree, and past words that do not if ``sure`` words agree behind them. ``i`` and ``j`` are the next places in direction
    ``step``. What is passed wrongly lowers the identity of the alignment, which decides."""
    if step < 0:
        i, j = grow(x[i::-1] if i >= 0 else x[:0], y[j::-1] if j >= 0 else y[:0], 0, 0, 1, sure), (i, j)
        return j[0] - i[0], j[1] - i[1]
    while True:
        n = min(len(x) - i, len(y) - j)
        same = x[i : i + n] == y[j : j + n]
        run = n if same.all() else int(same.argmin())
        i, j = i + run, j + run
        for di, dj in MOVES:
            a, b = i + di, j + dj
            if a + sure <= len(x) and b + sure <= len(y) and (x[a : a + sure] == y[b : b + sure]).all():
                i, j = a, b
                break
        else:
            return i, j


CHAIN = "doc long, a long, b long, other long, oa long, ob long"


def groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that follow one another, with their ends; the group a batch ends in is held back."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for name in names:
            c = t.column(name).to_numpy()
            new |= c[1:] != c[:-1]
        cut = np.flatnonzero(new) + 1
        if len(cut):
            yield t.slice(0, cut[-1]), cut
            t = t.slice(cut[-1])
        held = t
    if held is not None and held.num_rows:
        yield held, np.array([held.num_rows])


def first_places(seeds: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc, pos, other, opos: every place of a hash found in several documents, with the first one. First places are written before they are joined: the join
    then has exchanges of its own, and Spark can split a hash that is in very many places."""
    place = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).cast("int").alias("pos")
    first = seeds.groupBy("h").agg(F.min(F.struct("doc", place)).alias("f"), F.max("doc").alias("z")).filter("f.doc <> z").select("h", F.col("f.doc").alias("other"), F.col("f.pos").alias("opos"))
    return seeds.join(scratch.save(first, name), "h").select("doc", "pos", "other", "opos")


def link(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of documents with earlier ones, as word ranges in both; the seeds of later rounds with the first places of such seeds, alike; and the places of all
    seeds found in several documents."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            i, h, p = seeds_of(part.column("text"))
            yield pa.record_batch([part.column("doc_id").take(pa.array(i)), pa.array(h.view(np.int64)), pa.array(p.astype(np.int32))], ["doc", "h", "pos"])

    seeds = scratch.save(docs.filter("doc_id is not null and text is not null").mapInArrow(seed, "doc long, h long, pos int"), "seeds")
    linked = scratch.save(first_places(seeds, scratch, "first"), "linked")
    scratch.drop("seeds", "first")

    def out(a: int, b: int, doc: np.ndarray, other: np.ndarray, pos: np.ndarray, opos: np.ndarray) -> Iterator[tuple]:
        for part in chains(anchors(pos[a:b], opos[a:b])):
            low, high = min(x[0] for x in part), max(x[1] for x in part)
            olow, ohigh = min(x[2] for x in part), max(x[3] for x in part)
            yield doc[a], low, high, other[a], olow, ohigh
            if sum(x[4] for x in part) < MIN_IDENTITY * max(high - low, ohigh - olow):  # the whole may fail where an anchor does not
                yield from ((doc[a], x[0], x[1], other[a], x[2], x[3]) for x in part if x[1] - x[0] < high - low)

    apart = linked.filter("doc <> other")
    place, first = (-1 - F.col("pos")).cast("long"), F.col("opos").cast("long")
    later = apart.filter("pos < 0").select("doc", place.alias("a"), (place + K).alias("b"), "other", first.alias("oa"), (first + K).alias("ob"))
    return by_pair(apart.filter("pos >= 0"), out, scratch, "chains"), later, linked


def by_pair(links: DataFrame, out, scratch: Scratch, name: str) -> DataFrame:
    """Rows of CHAIN that ``out`` makes of the links of each pair of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in groups(batches, "doc", "other"):
            doc, other, pos, opos = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "other", "pos", "opos"))
            rows = [r for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True) for r in out(a, b, doc, other, pos, opos)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], [c.split()[0] for c in CHAIN.split(", ")])

    dealt = links.select("doc", "other", "pos", "opos").repartition("doc", "other").sortWithinPartitions("doc", "other", "pos", "opos")
    return scratch.save(dealt.mapInArrow(run, CHAIN), name)


def uncovered(weak: DataFrame, found: DataFrame, margin: int = WINDOW - 1) -> DataFrame:
    """The chains that lie, with the words on both sides in which a window need not have a seed, in no passage found for their document."""
    names = [c.split()[0] for c in CHAIN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in groups(batches, "doc"):
            a, b, is_chain = (t.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "is_chain"))
            keep = is_chain.copy()
            for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                chain, passage = x + np.flatnonzero(is_chain[x:y]), x + np.flatnonzero(~is_chain[x:y])
                if len(passage) and len(chain):
                    passage = passage[np.argsort(a[passage], kind="stable")]
                    end = np.maximum.accumulate(b[passage])
                    at = np.searchsorted(a[passage], np.maximum(a[chain] - margin, 0), side="right") - 1
                    keep[chain] = (at < 0) | (end[np.maximum(at, 0)] < b[chain] + margin)
            yield from t.filter(pa.array(keep)).select(names).combine_chunks().to_batches()

    none = F.lit(0).cast("long")
    passages_ = found.select(F.col("doc_id").alias("doc"), F.col("start").alias("a"), F.col("end").alias("b"), *[none.alias(c) for c in names[3:]])
    both = weak.withColumn("is_chain", F.lit(True)).unionByName(passages_.withColumn("is_chain", F.lit(False)))
    return both.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, CHAIN)


def whole_windows(docs: DataFrame, linked: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Chains of equal windows that the links of single seeds may have lost; ``runs`` are the exact passages they gave: doc, start, end, other, diagonal."""

    def open_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in groups(batches, "doc"):
            doc, a, b, other, diagonal = (t.column(c).to_numpy() for c in ("doc", "a", "b", "other", "diagonal"))
            rows = []
            for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                seed, run = x + np.flatnonzero(b[x:y] < 0), x + np.flatnonzero(b[x:y] >= 0)
                if len(seed):
                    found = open_windows(a[seed], other[seed], diagonal[seed], list(zip(a[run].tolist(), b[run].tolist(), other[run].tolist(), diagonal[run].tolist(), strict=True)))
                    if found:
                        rows.append((doc[x], [r[0] for r in found], [r[1] for r in found]))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["doc", "a", "b"])

    places = linked.select("doc", F.col("pos").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), "other", (F.col("pos") - F.col("opos")).cast("long").alias("diagonal"))
    both = places.unionByName(runs.select("doc", F.col("start").alias("a"), F.col("end").alias("b"), "other", "diagonal"))
    asked = scratch.save(both.repartition("doc").sortWithinPartitions("doc").mapInArrow(open_in, "doc long, a array<long>, b array<long>"), "open")
    scratch.drop("linked")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            starts, codes, words = words_of(part.column("text"), lower=True)
            h = word_hashes(words)[codes] if len(codes) else np.zeros(0, U)
            doc, place, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, (d, a, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "a", "b")), strict=True)):
                own = h[starts[i] : starts[i + 1]]
                most = len(own) - MIN_WORDS + 1
                at = np.concatenate([np.arange(x, min(y, most)) for x, y in zip(a, b, strict=True) if x < most] or [np.zeros(0, np.int64)])
                if not len(at):
                    continue
                w = window_hashes(own)[at]
                order = np.argsort(w, kind="stable")
                same = w[order]
                n = np.arange(len(w))
                round_ = np.empty(len(w), np.int64)
                round_[order] = n - np.maximum.accumulate(np.where(np.concatenate(([True], same[1:] != same[:-1])), n, 0))
                later = np.flatnonzero(round_)  # rounds meet round by round, and each the first one
                doc.append(np.full(len(at) + len(later), d))
                place.extend((at, at[later]))
                key.extend((mix64(w + round_.astype(U) * STEP), mix64(w[later])))
            yield pa.record_batch([pa.array(np.concatenate(doc)), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(place).astype(np.int32))], ["doc", "h", "pos"])

    windows = scratch.save(texts_of(docs, asked, asked).mapInArrow(hashes, "doc long, h long, pos int"), "windows")

    def out(a: int, b: int, doc: np.ndarray, other: np.ndarray, pos: np.ndarray, opos: np.ndarray) -> Iterator[tuple]:
        for x in cover(anchors(pos[a:b], opos[a:b], MIN_WORDS, 0)):
            yield doc[a], x[0], x[1], other[a], x[2], x[3]

    found = by_pair(first_places(windows, scratch, "first_windows").filter("doc <> other"), out, scratch, "whole")
    scratch.drop("windows", "first_windows", "open")
    return found


def texts_of(docs: DataFrame, asked: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ``asked``, which has ``doc``, with the texts of its documents; ``ids`` has the same documents."""
    return of_ids(docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text"), ids).join(asked, "doc")


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc`` is in ``ids``, and a few others, without a shuffle."""
    bits = rows.sparkSession.sparkContext.broadcast(id_filter(ids, "doc"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column("p").to_numpy()
            yield batch.filter(pa.array((bits.value[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1).astype(bool)))

    hashed = rows.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)).cast("long"))
    return hashed.mapInArrow(pick, hashed.schema).drop("p")


def words_in(docs: DataFrame, ranges: DataFrame, scratch: Scratch, name: str = "words") -> DataFrame:
    """doc, ra, rb and the hashes of those words, for distinct ranges (doc, ra, rb)."""
    ranges = ranges.distinct()
    asked = ranges.groupBy("doc").agg(F.count("*").alias("n")).join(ranges, "doc")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("ra", "rb"), F.ceil(F.col("n") / ASK))).groupBy("doc", "g").agg(F.collect_list("ra").alias("ra"), F.collect_list("rb").alias("rb"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            starts, codes, words = words_of(part.column("text"), lower=True)
            h = word_hashes(words)
            rows = []
            for i, (doc, ra, rb) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "ra", "rb")), strict=True)):
                own = codes[starts[i] : starts[i + 1]]
                rows.extend((doc, a, b, h[own[a:b]].tobytes()) for a, b in zip(ra, rb, strict=True))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "ra", "rb", "words"])

    cut_words = texts_of(docs, asked, ranges).mapInArrow(cut, WORDS)
    return scratch.save(cut_words.dropDuplicates(["doc", "ra", "rb"]), name)


WORDS = "doc long, ra long, rb long, words binary"
OUT = "doc_id long, start long, end long, other_id long, other_start long, other_end long, distance int, identity double"
ALIGNED = OUT + ", ra long, rb long, settled boolean, keys array<long>, places array<long>"


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """doc_id, start, end (words, end exclusive), other_id, other_start, other_end, distance (words), identity: passages a document shares with the one
    that has them first; ``both_sides`` adds the first ones themselves."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chained, later, linked = link(docs, scratch)
    found = scratch.save(aligned(docs, chained, scratch, "words", min_words, min_identity), "aligned")
    scratch.drop("chains")
    more = relink(found, spark.read.schema(WORDS).parquet(f"{scratch.path}/words"), scratch, min_words, min_identity)
    left = scratch.save(uncovered(later, passing(found)), "left")
    parts = [found, *more, scratch.save(aligned(docs, left, scratch, "words", min_words, min_identity), "aligned_later")]
    shared = scratch.save(reduce(DataFrame.unionByName, map(passing, parts)).distinct(), "shared")
    exact = shared.filter(F.col("distance") == 0)
    runs = exact.select(F.col("doc_id").alias("doc"), "start", "end", F.col("other_id").alias("other"), (F.col("start") - F.col("other_start")).alias("diagonal"))
    firsts = exact.select(F.col("other_id").alias("doc"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("other_id").alias("other"), F.lit(0).cast("long").alias("diagonal"))
    scratch.drop("words", "left", "aligned", "aligned_later", *[f"relinked-{i}" for i in range(len(more))])
    more = aligned(docs, whole_windows(docs, linked, runs.unionByName(firsts).distinct(), scratch), scratch, "whole_words", min_words, min_identity)
    return shared.unionByName(passing(more)).distinct()


def passing(found: DataFrame) -> DataFrame:
    """The passages among aligned chains, the later document first."""
    own, other = ("doc_id", "start", "end"), ("other_id", "other_start", "other_end")
    turned = F.col("doc_id") < F.col("other_id")
    sides = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (*zip(own, other, strict=True), *zip(other, own, strict=True))]
    return found.filter("identity is not null").select(*sides, "distance", "identity")


def relink(found: DataFrame, words: DataFrame, scratch: Scratch, min_words: int, min_identity: float) -> list[DataFrame]:
    """Aligned links of places whose seed's first place is in no passage with them, to others than that. Two places can grow further together than with the first one only
    if, past an end of what each has in common with it, both go on with the same two words (``MOVES``). So places meet again under the seed and those words, are linked to
    one of them, and go on so until none that is still without a passage meets another: every group is smaller by that one than the one it is from. ``words``
    is the scratch table of that name, which is deleted once the first round has its part of it."""
    out: list[DataFrame] = []
    while True:
        n = len(out)
        rows = (out[-1] if out else found).select("doc_id", "ra", "rb", "settled", F.explode(F.arrays_zip("keys", "places")).alias("e"))
        rows = rows.select(F.col("doc_id").alias("doc"), F.col("e.places").alias("a"), "ra", "rb", F.col("e.keys").alias("key"), "settled")
        rows = rows.withColumn("settled", F.max("settled").over(W.partitionBy("doc", "a")))
        widest = F.max(F.struct(F.col("rb") - F.col("ra"), "ra", "rb")).alias("r")  # has the most words to grow into
        rows = rows.groupBy("key", "doc", "a").agg(widest, F.max("settled").alias("settled")).select("doc", "a", "r.ra", "r.rb", "key", "settled")
        rows = scratch.save(rows, f"ends-{n}")
        one = F.min(F.struct(~F.col("settled"), "doc", "a", "ra", "rb")).alias("f")
        first = rows.groupBy("key").agg(one, F.min("doc").alias("y"), F.max("doc").alias("z"), F.min("settled").alias("all")).filter("y <> z and not all")
        first = scratch.save(first.select("key", F.col("f.doc").alias("other"), F.col("f.a").alias("oa"), F.col("f.ra").alias("ora"), F.col("f.rb").alias("orb")), f"first_ends-{n}")
        met = rows.join(first, "key").filter("doc <> other").withColumns({"b": F.col("a") + K, "ob": F.col("oa") + K})
        met = scratch.save(met, f"met-{n}")
        ids = met.select("doc").unionByName(met.select(F.col("other").alias("doc")))
        words = scratch.save(of_ids(words, ids), f"words-{n}")  # the next round's documents are among these
        scratch.drop(f"words-{n - 1}" if n else "words", f"ends-{n}", f"first_ends-{n}")
        made = scratch.save(compared(met, words, min_words, min_identity), f"relinked-{n}")
        scratch.drop(f"met-{n}")
        if made.isEmpty():
            scratch.drop(f"words-{n}", f"relinked-{n}")
            return out
        out.append(made)


def aligned(docs: DataFrame, found: DataFrame, scratch: Scratch, name: str, min_words: int, min_identity: float) -> DataFrame:
    """Chains grown at both ends and aligned, those that are long and alike enough."""
    wide = found.withColumns(  # ranges are widened to full steps of 16 words, so that ranges around one passage are alike
        {
            "ra": F.greatest(F.lit(0), F.floor((F.col("a") - FLANK) / 16) * 16), "rb": F.ceil((F.col("b") + FLANK) / 16) * 16,
            "ora": F.greatest(F.lit(0), F.floor((F.col("oa") - FLANK) / 16) * 16), "orb": F.ceil((F.col("ob") + FLANK) / 16) * 16,
        }
    )
    ranges = wide.select("doc", "ra", "rb").unionByName(wide.select(F.col("other").alias("doc"), F.col("ora").alias("ra"), F.col("orb").alias("rb")))
    words = words_in(docs, ranges, scratch, name)
    scratch.drop()
    return compared(wide.withColumns({"key": F.lit(0).cast("long"), "settled": F.lit(False)}), words, min_words, min_identity)


def compared(wide: DataFrame, words: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """A row for each chain, whose ranges are in ``words``: the passage, with a null identity if it is too short or its copies differ too much, and the
    ``keys`` of its ends for ``relink`` with the ``places`` of the seeds they are from."""

    def side(*to: str) -> DataFrame:
        """The words under other names: both sides have new ones, so that they are one plan to Spark, which then shuffles the words once."""
        return words.select(*[F.col(x).alias(y) for x, y in zip(("doc", "ra", "rb", "words"), to, strict=True)])

    own, other = side("_doc", "_ra", "_rb", "words_"), side("_other", "_ora", "_orb", "owords")
    both = wide.join(own, (F.col("doc") == F.col("_doc")) & (F.col("ra") == F.col("_ra")) & (F.col("rb") == F.col("_rb")))
    both = both.join(other, (F.col("other") == F.col("_other")) & (F.col("ora") == F.col("_ora")) & (F.col("orb") == F.col("_orb"))).withColumnRenamed("words_", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        types = [*[pa.int64()] * 6, pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc", "a", "b", "other", "oa", "ob", "ra", "ora", "rb", "settled")]
            xs = [np.frombuffer(x.as_buffer(), U) for x in batch.column("words")]
            for doc, a, b, oth, oa, ob, ra, ora, rb, settled, x, y in zip(*columns, xs, batch.column("owords"), strict=True):
                y = np.frombuffer(y.as_buffer(), U)
                i, j = grow(x, y, a - ra - 1, oa - ora - 1, -1)
                s, t = grow(x, y, b - ra, ob - ora, 1)
                i, j = i + 1, j + 1
                n, d, same = max(s - i, t - j), None, None
                if min(s - i, t - j) >= min_words:
                    d = distance(x[i:s], y[j:t])
                    same = 1 - d / n if 1 - d / n >= min_identity else None
                rows.append((doc, ra + i, ra + s, oth, ora + j, ora + t, d, same, ra, rb, settled or same is not None))
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([*arrays, *ends(xs, rows, np.array(columns[1], np.int64), np.array(columns[2], np.int64), batch.column("key").to_numpy())], names)

    return both.select("doc", "a", "b", "other", "oa", "ob", "ra", "ora", "rb", "settled", "key", "words", "owords").mapInArrow(align, ALIGNED)


def ends(xs: list[np.ndarray], rows: list[tuple], a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each chain, hashes of its outermost seed (or of the key it is from) with two words that follow its grown end at once or up to three words on; on both sides."""
    size = np.array([len(x) for x in xs], np.int64)
    start, ra = np.cumsum(size) - size, np.array([r[8] for r in rows], np.int64)
    low, high = np.array([r[1] for r in rows], np.int64) - ra, np.array([r[2] for r in rows], np.int64) - ra
    flat, key = np.concatenate([*xs, np.zeros(K, U)]), key.view(U)
    row, made, place = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for side, at in enumerate((b - K, a)):
        gram = np.zeros(len(xs), U)
        for j in range(K):
            gram = mix64(gram * STEP + flat[start + at - ra + j])
        base = mix64(np.where(key == 0, gram, key) + SIDES[side])
        for skip in range(1 + max(max(m) for m in MOVES)):
            x = low - skip - 2 if side else high + skip
            ok = np.flatnonzero((x >= 0) & (x + 2 <= size))
            here = start[ok] + x[ok]
            row.append(ok)
            made.append(mix64(mix64(base[ok] * STEP + flat[here]) * STEP + flat[here + 1]))
            place.append(at[ok])
    row_, made_, place_ = map(np.concatenate, (row, made, place))
    order = np.argsort(row_, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row_, minlength=len(xs))))).astype(np.int32)
    return tuple(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[order].view(np.int64))) for v in (made_, place_))


def both_sides(shared: DataFrame) -> DataFrame:
    """The passages, and each first passage once, with the least document that repeats it."""
    first = shared.groupBy(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end")).agg(F.min(F.struct("doc_id", "start", "end", "distance", "identity")).alias("m"))
    turned = first.select("doc_id", "start", "end", F.col("m.doc_id").alias("other_id"), F.col("m.start").alias("other_start"), F.col("m.end").alias("other_end"), F.col("m.distance").alias("distance"), F.col("m.identity").alias("identity"))
    return shared.unionByName(turned)
