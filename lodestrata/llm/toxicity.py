"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates over a whole text: hits of an abuse lexicon (plain and obfuscated), hits close to the second person, capitals, punctuation and
symbols inside words. The lexicon is a short fixed list together with words that mark toxic rows among the labelled ones. Trees are fitted in
numpy on histograms; calibration is the isotonic fit of out-of-fold margins to the labels. What a fold's margins rest on, the lexicon included, is
learned without that fold.

Fitting takes a bounded sample of labelled rows, ``max_rows`` a class in the order of a hash of the id; it is the only bounded step. Rows are weighted
by what their class has among all training labels for each one sampled, in the lexicon's rates, the trees and the calibration, so scores are
probabilities at the true class ratio whatever the size. Scoring reads every text whole, in slices, without a shuffle.

Defined cases: null and empty texts have all rates 0 and are scored like that; null or other labels are not learned from, and of an id labelled twice
the higher label counts; with labels of one class only the score is that class, with none 0; repeated rows are scored each; an empty table
gives no rows; a column of the output's name is replaced, others may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Scratch, forget, keep, segment_sums, text_slices, unused, word_hashes, words_of

MAX_ROWS, FOLDS = 5000, 4
CACHE_WORDS = 1_500_000
NEAR = 6
# Common insults, second-person words, and characters that stand for letters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb scum loser losers trash garbage pathetic worthless clown fool jerk imbecile disgusting vermin filth filthy".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
DROP = str.maketrans("", "", ".*-_~|+'`^\"")
FEATURES = ("lexicon", "lexicon_count", "marked", "obfuscated", "second", "near_second", "capitals", "shouted", "punctuation", "exclamation", "mixed", "words", "weight")
HIT, MARKED, OBFUSCATED, YOU, SHOUT, MIXED = 1, 2, 4, 8, 16, 32


def plain(word: str) -> str:
    """Lower case without signs at either end."""
    return word.lower().strip(STRIP)


def clear(word: str) -> str:
    """The word behind an obfuscation: stand-ins turned to letters, separators dropped, letters repeated three times or more cut to one."""
    out = word.lower().strip(".,;:?\"'()[]{}<>*-_~|").translate(LEET).translate(DROP)
    if any(out[i] == out[i + 1] == out[i + 2] for i in range(len(out) - 2)):
        short = [c for i, c in enumerate(out) if not (i >= 1 and out[i - 1] == c)]
        return "".join(short)
    return out


class Extractor:
    """Features of texts; what a word is gets looked up once per distinct word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.known, self.bits, self.weights = HashIndex(), np.zeros(0, np.uint8), np.zeros(0, np.float32)

    def _word(self, word: str) -> tuple[int, float]:
        bare, bits, weight = plain(word), 0, 0.0
        if bare in INSULTS:
            bits, weight = HIT, 1.0
        if bare in self.lexicon:
            bits, weight = bits | MARKED, self.lexicon[bare]
        if not bits and any(not c.isalpha() for c in bare) or not bits and len(bare) > 4:
            hidden = clear(word)
            if hidden != bare and (hidden in INSULTS or hidden in self.lexicon):
                bits, weight = OBFUSCATED | (HIT if hidden in INSULTS else MARKED), self.lexicon.get(hidden, 1.0)
        if bare in SECOND:
            bits |= YOU
        if len(bare) > 1 and word.upper() == word and word.lower() != word:
            bits |= SHOUT
        if bare and not bare.isalpha() and any(c.isalpha() for c in bare):
            bits |= MIXED
        return bits, weight

    def __call__(self, text: pa.Array) -> np.ndarray:
        text = pc.fill_null(text, "")
        starts, codes, words = words_of(text)
        if len(self.known) + len(words) > CACHE_WORDS:
            self.clear()
        hashes = word_hashes(words)
        fresh = np.flatnonzero(self.known.find(hashes) < 0)
        if len(fresh):
            made = [self._word(words[i]) for i in fresh]
            self.known.add(hashes[fresh])
            self.bits = np.concatenate((self.bits, np.array([b for b, _ in made], np.uint8)))
            self.weights = np.concatenate((self.weights, np.array([x for _, x in made], np.float32)))
        where = self.known.find(hashes)[codes] if len(codes) else np.zeros(0, np.int64)
        bits, weight = self.bits[where], self.weights[where]
        n = np.diff(starts).astype(float)
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        has = lambda bit: (bits & bit) > 0
        you, hit = np.flatnonzero(has(YOU)), np.flatnonzero(has(HIT | MARKED))
        near = np.zeros(len(bits), bool)
        if len(you) and len(hit):
            at = np.searchsorted(you, hit)
            for side in (np.minimum(at, len(you) - 1), np.maximum(at - 1, 0)):
                near[hit] |= (np.abs(you[side] - hit) <= NEAR) & (doc[you[side]] == doc[hit])
        count = lambda v: segment_sums(v.astype(np.float64), starts)
        per = 100 / np.maximum(n, 1)
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], np.int32, len(text) + 1 + text.offset)[text.offset :].astype(np.int64) if text.type == pa.string() else np.frombuffer(buffers[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        kinds = CLASSES[raw]
        of = lambda kind: np.diff(np.concatenate(([0], np.cumsum(kinds == kind)))[offsets - offsets[0]])
        chars = np.maximum(np.diff(offsets), 1)
        upper, low, sign, bang = of(1), of(2), of(3), of(4)
        return np.column_stack(
            (
                count(has(HIT)) * per, np.log1p(count(has(HIT))), count(has(MARKED)) * per, count(has(OBFUSCATED)) * per, count(has(YOU)) * per, count(near) * per, upper / np.maximum(upper + low, 1),
                count(has(SHOUT)) * per, (sign + bang) / chars, bang / chars, count(has(MIXED)) * per, np.log1p(n), count(weight) * per,
            )
        )


CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91], CLASSES[97:123] = 1, 2
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
CLASSES[[33, 63]] = 4


# -- trees ----------------------------------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of equal depth as flat arrays: node i has children 2i + 1 and 2i + 2; a leaf repeats downwards."""

    base: float = 0.0
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (1 << self.depth) + 1]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Logistic loss, second-order gains, histograms over quantile bins. A row counts ``weight`` times in the loss."""
    weight = np.ones(len(y)) if weight is None else weight
    p0 = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3)
    trees = Trees(math.log(p0 / (1 - p0)), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), trees.base)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        at_cut = np.full(inner, bins + 1)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slot = node - first
            gain = np.zeros(width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = slot * (bins + 1) + binned[:, j], width * (bins + 1)
                gl = np.cumsum(np.bincount(key, g, size).reshape(width, -1), axis=1)
                hl = np.cumsum(np.bincount(key, h, size).reshape(width, -1), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gains = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gains[(hl < least) | (ht - hl < least)] = 0
                gains = gains[:, : len(c)]
                best = gains.argmax(axis=1)
                value = gains[np.arange(width), best]
                better = value > gain + 1e-9
                gain[better] = value[better]
                where = first + np.flatnonzero(better)
                feature[where], cut[where], at_cut[where] = j, c[best[better]], best[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > at_cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, 1 << depth) / (np.bincount(slot, h, 1 << depth) + ridge)
        margin += leaf[slot]
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.leaf.append(leaf)
    return trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and rising values; between knots the curve is straight."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sums of labels, weights and scores
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([float(t * w), float(w), float(s * w)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def fit_model(lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, without: list[np.ndarray]) -> Model:
    """``without[f]`` are the features under the lexicon that was learned without fold f."""
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, np.zeros(1), np.zeros(1), float(y[0]) if len(y) else 0.0)
    out = np.zeros(len(y))
    for f, own in enumerate(without):
        if (fold == f).any() and (fold != f).any():
            out[fold == f] = fit_trees(own[fold != f], y[fold != f], weight[fold != f]).margin(own[fold == f])
    return Model(lexicon, fit_trees(x, y, weight), *isotonic(out, y, weight))


# -- Spark ------------------------------------------------------------------------------------------------------------------------------------


def marked_rows(labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, toxic: one row per labelled id, toxic if any of its labels is. ``learn`` is a condition on labels' doc_id."""
    return labels.filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold: at most ``max_rows`` of each class, by a hash of the id. ``learn`` is a condition on labels' doc_id."""
    marked = marked_rows(labels, learn)
    part = lambda t: marked.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    taken = part(0).unionByName(part(1))  # at most 2 * max_rows ids, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7 * FOLDS)).cast("int") % FOLDS)


def class_weights(labels: DataFrame, learn: Column, max_rows: int) -> dict[int, float]:
    """How much a sampled row of each class counts, for the classes to weigh as they do among all training labels; the mean weight is 1."""
    total = {r["toxic"]: r["n"] for r in marked_rows(labels, learn).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = {t: min(n, max_rows) for t, n in total.items()}
    return {t: n / taken[t] * sum(taken.values()) / sum(total.values()) for t, n in total.items()}


def word_counts(rows: DataFrame) -> DataFrame:
    """word, fold, bad, n: in how many toxic rows and rows in all of each fold a word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in text_slices(batches):
            starts, codes, words = words_of(part.column("text"))
            toxic, fold = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "fold"))
            doc = np.repeat(np.arange(len(toxic)), np.diff(starts))
            index = {w: i for i, w in enumerate(dict.fromkeys(map(plain, words)))}
            own = np.array([index[plain(w)] for w in words], np.int64)[codes] if words else codes.astype(np.int64)
            d, w = np.divmod(np.unique(doc * max(1, len(index)) + own), max(1, len(index)))
            key, at = np.unique(w * FOLDS + fold[d], return_inverse=True)
            bad, n = np.bincount(at, toxic[d], len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            yield pa.record_batch([pa.array(list(index), pa.string()).take(pa.array(key // FOLDS)), pa.array((key % FOLDS).astype(np.int32)), pa.array(bad), pa.array(n.astype(np.int64))], ["word", "fold", "bad", "n"])

    return rows.mapInArrow(run, "word string, fold int, bad long, n long").groupBy("word", "fold").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def learn_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], weights: dict[int, float], without: int = -1, most: int = 400, least_z: float = 5.0, least_share: float = 0.02) -> dict[str, float]:
    """Words that are in far more toxic rows than chance would put there, with a weight between 0 and 1, learned from all folds but one. A word must be in ``least_share`` of
    the toxic rows, so that a few copies of one mislabelled text add none. Chance is that of the sample; rates are weighted by class."""
    bad, good = (sum(n for (t, f), n in totals.items() if t == toxic and f != without) for toxic in (1, 0))
    if not bad or not good:
        return {}
    n, share = bad + good, bad / (bad + good)
    counts = counts.filter(F.col("fold") != without).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    toxic, other = F.col("bad") * weights[1], (F.col("n") - F.col("bad")) * weights[0]
    rate, true_share = toxic / (toxic + other), bad * weights[1] / (bad * weights[1] + (n - bad) * weights[0])
    top = counts.filter((F.length("word") > 1) & (F.col("bad") >= max(4, math.ceil(least_share * bad)))).select("word", z.alias("z"), rate.alias("rate")).filter((F.col("z") >= least_z) & (F.col("rate") >= min(0.95, 1.5 * true_share))).orderBy(F.desc("z"), "word").limit(most)
    return {r["word"]: float(r["rate"]) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(training_rows(docs, labels, learn, max_rows), "rows")  # read once of the corpus; 2 * max_rows
    weights = class_weights(labels, learn, max_rows)
    totals = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    counts = scratch.save(word_counts(rows), "counts")
    lexica = [learn_lexicon(counts, totals, weights, f) for f in (*range(FOLDS), -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        extract = [Extractor(lexicon) for lexicon in lexica]
        for part in text_slices(batches):
            x = np.concatenate([e(part.column("text")) for e in extract], axis=1)
            yield pa.record_batch([*(part.column(c) for c in ("doc_id", "toxic", "fold")), *[pa.array(c) for c in x.T]], ["doc_id", "toxic", "fold", *names])

    width = len(FEATURES)
    names = [f"f{i}" for i in range(width * len(lexica))]
    found = rows.mapInArrow(run, "doc_id long, toxic int, fold int, " + ", ".join(f"{c} double" for c in names)).orderBy("doc_id", *names).toPandas()  # bounded: 2 * max_rows
    scratch.drop("rows", "counts")
    x = [found[names[i * width : (i + 1) * width]].to_numpy(float) for i in range(len(lexica))]
    weight = found["toxic"].map(weights).to_numpy(float)
    return fit_model(lexica[-1], x[-1], found["toxic"].to_numpy(float), weight, found["fold"].to_numpy(), x[:-1])


def extractor(model: Model) -> Extractor:
    return keep(("extractor", zlib.crc32(repr(sorted(model.lexicon.items())).encode())), lambda: Extractor(model.lexicon))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with the calibrated probability in ``out``; a column of that name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred words and 80 small trees
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor(shared.value)
        for part in text_slices(batches, text_col):
            s = shared.value.score(extract(part.column(text_col)))
            yield pa.record_batch([*part.columns, pa.array(s)], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that score below ``least``, with the columns of ``docs``."""
    out = unused("toxicity", docs.columns)
    return score(docs, model, out=out).filter(F.col(out) < least).drop(out)
