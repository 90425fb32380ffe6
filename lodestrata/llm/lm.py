"""Language-model scoring with a log-frequency Bloom filter.

Counting: words and word pairs are 64-bit hashes. Tasks count their own part of the corpus and send sorted keys with counts, cut by key range; a
reducer merges one range at a time. Keys are spread evenly by the hash, so no word is a hot key, and a frequent one is a single entry per task. Ranges
are as many as the text needs, ``RANGE_BYTES`` of it each; beyond 2^FAN_BITS of them keys are cut in two steps.

Filter: a count c is quantised to q = 1 + floor(log2(c)) levels, and (key, 1) .. (key, q) are set in a Bloom filter; a count is read back by probing
levels until one is absent. Every pair of the corpus is in it, those seen once too, at ``bits_per_key`` whatever its size. Pairs frequent enough for
``max_bytes`` to hold them are in a filter that is broadcast; that holds everything while the corpus is small. The others stay in segments, one for
each key range, and the probes go to them: a slice of text sends the pairs the broadcast filter lacks to their ranges and gets levels back. So
each slice costs the same whatever the corpus, and nothing that is broadcast or sent to the driver grows with it.

Model: P(w | v) mixes the pair's share of v's count with the add-one share of w, the more of the first the more often v was seen. Word counts, quantised in
the same way here, are known exactly for the base score: words frequent enough for at most ``top_words`` of them to be so are looked up in a sorted
table that is broadcast, the rest are asked of the ranges along with the pairs.

Texts are read twice for scoring, once for what they ask and once for the answers. Both readings cut a partition into the same slices; if its rows came in
another order the second time, the answers' checksums would differ and the query would fail, not return wrong scores. Inputs whose rows may change
places when a partition is computed again should be written first.

Defined cases: null and empty texts are the end token alone; a null id is neither held out nor learned from; repeated rows count and are scored each;
with no training text N = V = 0 and scores are still finite; an empty table gives no rows. Different words share a count if their 64-bit
hashes meet, which for 10^8 words happens to any pair at all with probability 3 in 10,000; pairs are told apart by 40 bits inside a range, which
adds less to the filter's errors than its false positives by a factor of thousands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, segment_sums, text_slices, word_hashes, words_of

BITS_PER_KEY, PROBES, MAX_BYTES = 10, 6, 8 << 20
TOP_WORDS = 400_000
RANGE_BYTES = 16 << 20
FAN_BITS, MOST_BITS, PAIR_BITS = 12, 24, 40
SEGMENT_BITS = 6
FLUSH_KEYS = 2_000_000
LEVELS = 48
MIX, TRUST = 0.4, 4.0
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
START, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * M1 + (second ^ (second >> U(32))) * M3 + M2)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.concatenate((first, [len(keys)])))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of all texts, lower-cased (A-Z), without end tokens."""
    starts, codes, words = words_of(text, lower=True)
    return starts, word_hashes(words)[codes] if len(codes) else np.zeros(0, U)


def with_ends(starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, tokens and the token before each, with an end token on every text and a start mark before it."""
    n = len(starts) - 1
    new = starts + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, U)
    place = np.ones(len(out), bool)
    place[new[1:] - 1] = False
    out[place] = hashes
    before = np.concatenate(([START], out[:-1])) if len(out) else out
    before[new[:-1]] = START
    return new, out, before


def _u64(b) -> np.ndarray:
    return np.frombuffer(b, U)


def packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those of 255 and more in eight bytes before them."""
    big = counts[counts >= 255].astype(np.int64)
    return np.int64(len(big)).tobytes() + big.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpacked(b) -> np.ndarray:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    out = np.frombuffer(b, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(b, np.int64, n, 8)
    return out


# -- the filter -----------------------------------------------------------------------------------------------------------------------------------


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(c)), 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for."""
    return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5, 0.0)


@dataclass
class LogBloom:
    """Bloom filters by the key's top bits: the one of segment s has the bits from ``edges[s]`` to ``edges[s + 1]``, a power of two of segments."""

    edges: np.ndarray
    data: np.ndarray

    def segment(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.edges) - 1
        return (keys >> U(65 - n.bit_length())).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it is absent."""
        out, alive, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        at = self.segment(keys)
        first, size = self.edges[at], (self.edges[at + 1] - self.edges[at]).astype(U)
        alive = alive[size > 0]
        while len(alive) and level < 64:
            h = mix64(keys[alive] + U(level * int(M1) & (1 << 64) - 1))
            for i in range(PROBES):
                place = first[alive] + _place(h, i, size[alive])
                ok = (self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                alive, h = alive[ok], h[ok]
            out[alive] = level
            level += 1
        return out


def _place(h: np.ndarray, i: int, size) -> np.ndarray:
    return (((h + U(i) * ((h >> U(32)) | U(1))) & U(0xFFFFFFFF)) * size >> U(32)).astype(np.int64)


def filled(keys: np.ndarray, level: np.ndarray, bits_per_key: int) -> bytes:
    """One segment with all levels of its keys; its size follows from them."""
    bits = -(-max(1, int(level.sum()) * bits_per_key) // 64) * 64
    out = np.zeros(bits, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        h = mix64(keys[level >= q] + U(q * int(M1) & (1 << 64) - 1))
        for i in range(PROBES):
            out[_place(h, i, U(bits))] = True
    return np.packbits(out, bitorder="little").tobytes()


def joined(parts: list[bytes]) -> LogBloom:
    """A filter of segments in order."""
    return LogBloom(np.concatenate(([0], np.cumsum([8 * len(p) for p in parts]))).astype(np.int64), np.frombuffer(b"".join(parts), np.uint8))


# -- counting -----------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Statistics:
    """What the corpus gives: totals, the count table (one row per key range) and how many words and pairs are of each level."""

    tokens: int
    distinct: int
    documents: int
    bits: int
    table: DataFrame
    words_by_level: np.ndarray
    pairs_by_level: np.ndarray


def trimmed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Pair keys with the bits that tell them apart: the range and PAIR_BITS more."""
    drop = U(MOST_BITS - bits)
    return keys >> drop << drop


def short(keys: np.ndarray, bits: int) -> bytes:
    """Trimmed keys of one range in five bytes each."""
    return np.ascontiguousarray((keys << U(bits) >> U(64 - PAIR_BITS)).view(np.uint8).reshape(-1, 8)[:, : PAIR_BITS // 8]).tobytes()


def long(b, range_: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, PAIR_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : PAIR_BITS // 8] = raw
    return out.reshape(-1).view(U) << U(MOST_BITS - bits) | U(range_ << 64 - bits)


def runs(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall in, and where each begins, with the end."""
    r = (keys >> U(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    return r[at], np.append(at, len(r))


PARCEL = "range int, kind int, keys binary, counts binary"
WORDS, PAIRS, COARSE = 0, 1, 2  # pairs of one range, and of several


def parcels(words: tuple, pairs: tuple, by: int, bits: int) -> pa.RecordBatch:
    """Counted keys, cut by their ``by`` top bits."""
    out: list[tuple] = []
    for kind, (keys, counts) in ((WORDS, words), (PAIRS if by == bits else COARSE, pairs)):
        found, at = runs(keys, by)
        out.extend((r, kind, short(keys[a:b], bits) if kind == PAIRS else keys[a:b].tobytes(), packed(counts[a:b])) for r, a, b in zip(found.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
    return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "kind", "keys", "counts"])


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return counted(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, U), np.zeros(0, np.int64))


TABLE = "range int, wk binary, wc binary, pk binary, pq binary, bloom binary, tokens long, words long, w_hist array<long>, p_hist array<long>"


def gather(docs: DataFrame, learn: Column, scratch: Scratch, bits_per_key: int = BITS_PER_KEY) -> Statistics:
    """Counts words and pairs of the rows where ``learn`` holds."""
    train = docs.filter(learn).select("text")
    size = train.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    bits = min(MOST_BITS, max(3, (-(-(size["b"] or 0) // RANGE_BYTES) - 1).bit_length()))
    first = min(bits, FAN_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, n = [], [], 0
        for part in text_slices(batches):
            starts, hashes = tokens_of(part.column("text"))
            _, tokens, before = with_ends(starts, hashes)
            words.append(counted(hashes))
            pairs.append(counted(trimmed(pair_hashes(before, tokens), bits)))
            n += len(pairs[-1][0])
            if n > FLUSH_KEYS:
                yield parcels(summed(words), summed(pairs), first, bits)
                words, pairs, n = [], [], 0
        if pairs:
            yield parcels(summed(words), summed(pairs), first, bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r, kind, keys, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                r, kind, keys = r.as_py(), kind.as_py(), keys.as_buffer()
                yield r, kind, long(keys, r, bits) if kind == PAIRS else _u64(keys), unpacked(counts.as_buffer())

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, n = [], [], 0
        for _, kind, keys, counts in read(batches):
            (words if kind == WORDS else pairs).append((keys, counts))
            n += len(keys)
            if n > FLUSH_KEYS:
                yield parcels(summed(words), summed(pairs), bits, bits)
                words, pairs, n = [], [], 0
        if n:
            yield parcels(summed(words), summed(pairs), bits, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range follow one another; one range is held at a time."""
        current, held = None, ([], [])
        for r, kind, keys, counts in read(batches):
            if r != current:
                if current is not None:
                    yield close(current, held)
                current, held = r, ([], [])
            held[kind].append((keys, counts))
        if current is not None:
            yield close(current, held)

    def close(r: int, held: tuple[list, list]) -> pa.RecordBatch:
        (wk, wc), (pk, pc) = summed(held[WORDS]), summed(held[PAIRS])
        wq, pq = levels(wc), levels(pc)
        more = pq > 1  # pairs seen once are never frequent enough for the broadcast filter unless all are
        row = (r, wk.tobytes(), packed(wc), short(pk[more], bits), pq[more].tobytes(), filled(pk, pq, bits_per_key), int(wc.sum()), len(wk), np.bincount(wq, minlength=LEVELS).tolist(), np.bincount(pq, minlength=LEVELS).tolist())
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2], strict=True)], [c.split()[0] for c in TABLE.split(", ")])

    sent = train.mapInArrow(count, PARCEL)
    if bits > first:
        sent = sent.repartition(1 << first, "range").sortWithinPartitions("range").mapInArrow(cut_again, PARCEL)
    merged = sent.repartition(1 << bits, "range").sortWithinPartitions("range").mapInArrow(merge, TABLE)
    table = scratch.save(merged, "counts")
    total = table.agg(F.sum("tokens"), F.sum("words"), *[F.sum(F.col(c)[i]) for c in ("w_hist", "p_hist") for i in range(LEVELS)]).first()
    total = [x or 0 for x in total]
    n_docs = size["n"]
    return Statistics(total[0] + n_docs, total[1] + (n_docs > 0), n_docs, bits, table, np.array(total[2 : 2 + LEVELS]), np.array(total[2 + LEVELS :]))


def frequent_filter(stats: Statistics, max_bytes: int = MAX_BYTES, bits_per_key: int = BITS_PER_KEY) -> tuple[int, LogBloom]:
    """(j, filter): pairs of a level above j, the least that lets all levels of theirs go into ``max_bytes``. Segments are filled on the cluster."""
    entries = stats.pairs_by_level * np.arange(LEVELS)
    j = next(j for j in range(LEVELS) if entries[j + 1 :].sum() * bits_per_key <= 8 * max_bytes)
    bits = stats.bits
    if not j:
        rows = {r["range"]: r["bloom"] for r in stats.table.select("range", "bloom").collect()}  # max_bytes, and some bytes a range
        return 0, joined([bytes(rows.get(r, b"")) for r in range(1 << bits)])
    few = min(SEGMENT_BITS, bits)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, pk, pq in zip(*(batch.column(c) for c in ("range", "pk", "pq")), strict=True):
                r, q = r.as_py(), np.frombuffer(pq.as_buffer(), np.uint8)
                rows.append((r >> bits - few, long(pk.as_buffer(), r, bits)[q > j].tobytes(), q[q > j].tobytes()))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["seg", "keys", "q"])

    def fill(t: pa.Table) -> pa.Table:
        keys, q = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("keys", U), ("q", np.uint8)))
        return pa.table({"seg": t.column("seg")[:1], "bits": pa.array([filled(keys, q, bits_per_key)], pa.binary())})

    made = stats.table.select("range", "pk", "pq").mapInArrow(frequent, "seg int, keys binary, q binary").groupBy("seg").applyInArrow(fill, "seg int, bits binary")
    rows = {r["seg"]: bytes(r["bits"]) for r in made.collect()}  # max_bytes, and some bytes a segment
    return j, joined([rows.get(s, b"") for s in range(1 << few)])


def log_probabilities(own: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, distinct: int, mix: float = MIX) -> np.ndarray:
    """log10 P of words from the counts of the word, of the one before it and of both."""
    unigram = np.minimum(1.0, (own + 1) / (total + distinct + 1))
    share = mix * context / (context + TRUST)  # an unseen context has none, a rare one little
    return np.log10(share * np.minimum(pair, context) / np.maximum(context, 1) + (1 - share) * unigram)


# -- scoring ------------------------------------------------------------------------------------------------------------------------------------

MARK, RARE = 64, 255  # codes beside levels: the start or end mark, and a word that is asked for
ASKED = "range int, slice long, words binary, pairs binary"
ANSWER = "range int, slice long, counts binary, levels binary, sum long"
RECORD = (
    "slice long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, known array<long>, part array<double>, score array<double>, "
    "doc binary, own binary, context binary, rare_own binary, rare_context binary, fresh binary, level binary, sum long"
)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def wrapped(keys: np.ndarray) -> int:
    """The sum of keys as a signed 64-bit number."""
    return int(keys.sum(dtype=U).astype(np.int64)) if len(keys) else 0


def score(docs: DataFrame, learn: Column, held_out: Column, max_bytes: int = MAX_BYTES, top_words: int = TOP_WORDS, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``docs`` has doc_id and text."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lm")
    stats = gather(docs, learn, scratch, bits_per_key)
    least = next(q for q in range(1, LEVELS + 1) if stats.words_by_level[q:].sum() <= top_words)  # the least level of a word in the table

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("wk"), batch.column("wc"), strict=True):
                keys, counts = _u64(k.as_buffer()), unpacked(c.as_buffer())
                keep = levels(counts) >= least
                if keep.any():
                    yield pa.record_batch([pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], ["k", "c"])

    top = stats.table.select("wk", "wc").mapInArrow(frequent, "k binary, c binary").collect()  # top_words entries at most
    keys = np.concatenate([np.zeros(0, U), *[_u64(r["k"]) for r in top]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["c"], np.int64) for r in top]])
    order = np.argsort(keys)
    j, bloom = frequent_filter(stats, max_bytes, bits_per_key)
    shared = spark.sparkContext.broadcast((keys[order], counts[order], bloom))
    n, v, n_docs, bits = stats.tokens, stats.distinct, stats.documents, stats.bits
    all_words = least == 1  # the table has every word

    def look(text: pa.Array) -> tuple:
        """What a slice settles by itself and what it asks: per document the tokens, known ones, base and score so far; the open tokens, those with asked
        pairs first, in the order of the pairs; the distinct asked words and pairs in order."""
        top_keys, top_counts, model = shared.value
        starts, codes, words = words_of(text, lower=True)
        codes = codes.astype(np.int64)
        h = word_hashes(words)
        where = np.minimum(np.searchsorted(top_keys, h), max(0, len(top_keys) - 1))
        hit = top_keys[where] == h if len(top_keys) else np.zeros(len(h), bool)
        count = np.where(hit, top_counts[where], 0) if len(top_keys) else np.zeros(len(h), np.int64)
        used = np.zeros(len(h), bool)
        used[codes] = True
        asked = np.flatnonzero(~hit & used) if not all_words else np.zeros(0, np.int64)
        asked = asked[np.argsort(h[asked], kind="stable")]
        rank = np.full(len(h) + 1, -1)
        rank[asked] = np.arange(len(asked))
        code = np.append(levels(count), MARK).astype(np.uint8)  # the last one is the mark
        code[asked] = RARE
        # words with an end each, and the word before each
        m = len(starts) - 1
        ends = starts + np.arange(m + 1)
        own = np.full(len(codes) + m, len(h), np.int64)
        inner = np.ones(len(own), bool)
        inner[ends[1:] - 1] = False
        own[inner] = codes
        context = np.concatenate(([len(h)], own[:-1])) if len(own) else own
        context[ends[:-1]] = len(h)
        token, before = np.append(h, END)[own], np.append(h, START)[context]
        pairs = trimmed(pair_hashes(before, token), bits)
        level = model.levels(pairs)
        ask = level <= j if j else np.zeros(len(own), bool)
        open_ = ask | (rank[own] >= 0) | (rank[context] >= 0)
        doc = np.repeat(np.arange(m), np.diff(ends))
        logp = np.zeros(len(own))
        done = ~open_
        sizes = np.append(middle(code[:-1]), n_docs)
        logp[done] = log_probabilities(sizes[own[done]], sizes[context[done]], middle(level[done]), n, v)
        exact = np.append(count, n_docs)[own]
        exact[rank[own] >= 0] = 0
        known = segment_sums((exact > 0).astype(np.float64), ends).astype(np.int64)
        base = segment_sums(np.log10(exact + 1.0), ends) - np.diff(ends) * np.log10(n + v + 1)
        first = np.flatnonzero(ask)
        first = first[np.argsort(pairs[first], kind="stable")]
        fresh = np.concatenate(([True], pairs[first][1:] != pairs[first][:-1])) if len(first) else np.zeros(0, bool)
        rest = np.flatnonzero(open_ & ~ask)
        at = np.concatenate((first, rest))
        tokens = (doc[at], code[own[at]], code[context[at]], rank[own[at]], rank[context[at]], fresh, level[rest])
        return np.diff(ends), known, base, segment_sums(logp, ends), tokens, h[asked], pairs[first][fresh]

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            *_, words, pairs = look(part.column("text"))
            (wr, wa), (pr, pa_) = runs(words, bits), runs(pairs, bits)
            w = {r: words[a:b].tobytes() for r, a, b in zip(wr.tolist(), wa[:-1].tolist(), wa[1:].tolist(), strict=True)}
            p = {r: short(pairs[a:b], bits) for r, a, b in zip(pr.tolist(), pa_[:-1].tolist(), pa_[1:].tolist(), strict=True)}
            to = sorted(w.keys() | p.keys())
            yield pa.record_batch(
                [pa.array(to, pa.int32()), pa.array([part.column("rid")[0].as_py()] * len(to), pa.int64()), pa.array([w.get(r, b"") for r in to], pa.binary()), pa.array([p.get(r, b"") for r in to], pa.binary())],
                ["range", "slice", "words", "pairs"],
            )

    def answers(own: pa.Table, sent: pa.Table) -> pa.Table:
        """Exact counts of words and the levels of pairs of one range, for each slice that asks."""
        out: list[tuple] = []
        if own.num_rows:
            wk, wc = _u64(own.column("wk")[0].as_buffer()), unpacked(own.column("wc")[0].as_buffer())
            segment = joined([own.column("bloom")[0].as_py()])
        else:
            wk, wc, segment = np.zeros(0, U), np.zeros(0, np.int64), joined([b""])
        for r, slice_, words, pairs in zip(*(sent.column(c) for c in ("range", "slice", "words", "pairs")), strict=True):
            words, pairs = _u64(words.as_buffer()), long(pairs.as_buffer(), r.as_py(), bits)
            at = np.minimum(np.searchsorted(wk, words), max(0, len(wk) - 1))
            counts = np.where(wk[at] == words, wc[at], 0) if len(wk) else np.zeros(len(words), np.int64)
            out.append((r.as_py(), slice_.as_py(), packed(counts), segment.levels(pairs).tobytes(), wrapped(np.concatenate((words, pairs)))))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], [c.split()[0] for c in ANSWER.split(", ")])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            n_tokens, known, base, logp, (doc, own, context, rare_own, rare_context, fresh, level), words, pairs = look(part.column("text"))
            blobs = (doc.astype(np.uint32), own, context, rare_own[own == RARE].astype(np.int32), rare_context[context == RARE].astype(np.int32), np.packbits(fresh), level)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.array(x)) for x in (part.column("doc_id"), part.column("held_out"), n_tokens, known, base, logp)]
            yield pa.record_batch(
                [part.column("rid")[:1], *lists, *[pa.array([b.tobytes()], pa.binary()) for b in blobs], pa.array([wrapped(np.concatenate((words, pairs)))], pa.int64())], [c.split()[0] for c in RECORD.split(", ")]
            )

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of one slice, with what the ranges answered."""
        found = found.sort_by("range")
        counts = np.concatenate([np.zeros(0, np.int64), *[unpacked(x.as_buffer()) for x in found.column("counts")]])
        asked = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x.as_buffer(), np.uint8) for x in found.column("levels")]])
        if own.num_rows != 1 or sum(found.column("sum").to_pylist()) - own.column("sum")[0].as_py() & (1 << 64) - 1:
            raise RuntimeError("the rows of a partition came in another order when it was read again")
        blob = lambda c, t: np.frombuffer(own.column(c)[0].as_buffer(), t)
        lists = lambda c: own.column(c)[0].values
        known, base, logp = (lists(c).to_numpy().copy() for c in ("known", "part", "score"))
        doc, code, before, rest = blob("doc", np.uint32), blob("own", np.uint8), blob("context", np.uint8), blob("level", np.uint8)
        first = len(doc) - len(rest)
        level = np.concatenate((asked[np.cumsum(np.unpackbits(blob("fresh", np.uint8), count=first)) - 1] if first else asked[:0], rest))
        size, ahead = (np.where(c == MARK, n_docs, middle(np.minimum(c, MARK - 1))) for c in (code, before))
        size[code == RARE] = middle(levels(counts))[blob("rare_own", np.int32)]
        ahead[before == RARE] = middle(levels(counts))[blob("rare_context", np.int32)]
        np.add.at(logp, doc, log_probabilities(size, ahead, middle(level), n, v))
        exact = counts[blob("rare_own", np.int32)]
        np.add.at(base, doc[code == RARE], np.log10(exact + 1.0))
        np.add.at(known, doc[code == RARE], exact > 0)
        return pa.table(
            [lists("doc_id"), lists("held_out"), lists("n_tokens"), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base), pa.array(logp)], [c.split()[0] for c in SCORED.split(", ")]
        )

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.schema([pa.field(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in ANSWER.split(", ")]).empty_table()
        for batch in records(batches):
            yield from finish(pa.Table.from_batches([batch]), none).to_batches()

    if all_words and not j:  # nothing is asked
        return numbered.mapInArrow(alone, SCORED)
    made = numbered.mapInArrow(records, RECORD)
    sent = numbered.mapInArrow(asks, ASKED).repartition(1 << bits, "range")
    own = stats.table.select("range", "wk", "wc", "bloom").repartition(1 << bits, "range")
    found = own.groupBy("range").cogroup(sent.groupBy("range")).applyInArrow(answers, ANSWER)
    return made.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(finish, SCORED)
