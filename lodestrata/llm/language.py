"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the letter bytes of a text, lower-cased; bytes that are no letters (ASCII signs, digits, white space) end a sequence and reset its
state. All bytes above ASCII count as letters, so signs among them do too. A sequence of more than ``LONGEST`` bytes, as texts without spaces have, is cut at
character borders into sequences of that length at most; every byte is in one of them. The network labels every byte with a distribution over
languages; a document's distribution is the mean over its labelled bytes. Sequences do not depend on what surrounds them, so each distinct one is
run once per worker and kept up to a bound.

Training is backpropagation through time in numpy on a bounded sample: ``max_docs`` labelled documents a language (MAX_TOTAL in all) in the order of a hash
of the id, and ``max_words`` words of each. Nothing else is bounded: every whole text is labelled, without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if no language could be learned; rows with a null
language are not learned from; repeated rows are labelled each; an empty table gives no rows; columns named lang_pred or lang_score are replaced, others
may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HashIndex, keep, segment_sums, text_slices, unused, word_hashes, words_of

MAX_DOCS, MAX_WORDS, MAX_TOTAL = 500, 120, 20_000
LONGEST = 24
CACHE_WORDS = 600_000
EMBED, HIDDEN, STEPS, BATCH = 12, 16, 900, 384

LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91], LETTERS[97:123], LETTERS[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def letters_only(text: pa.Array) -> pa.Array:
    """The texts with letters lower-cased and everything else blank; byte lengths stay, so the offsets are shared."""
    text = pc.fill_null(text, "")
    buffers = text.buffers()
    if buffers[2] is None or not buffers[2].size:
        return text
    mapped = pa.py_buffer(LETTERS[np.frombuffer(buffers[2], np.uint8)].tobytes())
    return pa.Array.from_buffers(text.type, len(text), [None, buffers[1], mapped], offset=text.offset)


def pieces(word: str) -> list[bytes]:
    """The word's bytes, cut at character borders into parts of LONGEST at most."""
    raw, out, at = word.encode(), [], 0
    while len(raw) - at > LONGEST:
        end = at + LONGEST
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"emb": init(256, EMBED) * 4, "out": init(2 * HIDDEN, len(langs)), "bias": np.zeros(len(langs), np.float32)}
        for d in "fb":
            w |= {f"x{d}": init(EMBED, 3 * HIDDEN), f"u{d}": init(HIDDEN, 2 * HIDDEN), f"c{d}": init(HIDDEN, HIDDEN), f"a{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(langs, w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction, time first. Padding leaves the state as it is."""
        w, h = self.weights, HIDDEN
        t, n = mask.shape
        state, out = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
        table = w["emb"] @ w[f"x{d}"] + w[f"a{d}"]  # one row per byte
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = table[x[i]]
            gates = 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + state @ w[f"u{d}"])) + 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + (r * state) @ w[f"c{d}"])
            m = mask[i][:, None]
            nxt = state + m * z * (new - state)
            if keep is not None:
                keep.append((i, state, z, r, new))
            out[i] = state = nxt
        return out

    @staticmethod
    def _pad(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, seqs))
        raw = np.frombuffer(b"".join(s.ljust(t, b"\0") for s in seqs), np.uint8).reshape(len(seqs), t).T
        return raw, (np.arange(t)[:, None] < np.array([len(s) for s in seqs])[None, :]).astype(np.float32)

    def _probs(self, both: np.ndarray) -> np.ndarray:
        logit = both @ self.weights["out"] + self.weights["bias"]
        e = np.exp(logit - logit.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def label(self, seqs: list[bytes], chunk: int = 2048) -> np.ndarray:
        """Summed label distributions of every sequence, one row each. Sequences are run by length, so little is padded."""
        out = np.zeros((len(seqs), len(self.langs)), np.float32)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        for at in range(0, len(order), chunk):
            part = order[at : at + chunk]
            x, mask = self._pad([seqs[i] for i in part])
            p = self._probs(np.concatenate((self._run(x, mask, "f"), self._run(x, mask, "b")), axis=2))
            out[part] = (p * mask[:, :, None]).sum(axis=0)
        return out

    def gradient(self, seqs: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy per labelled byte and its gradient, by backpropagation through time."""
        w, h = self.weights, HIDDEN
        x, mask = self._pad(seqs)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p, total = self._probs(both), mask.sum()
        loss = float(-(np.log(p[:, np.arange(len(y)), y] + 1e-9) * mask).sum() / total)
        dl = p.copy()
        dl[:, np.arange(len(y)), y] -= 1
        dl *= (mask / total)[:, :, None]
        grad = {"out": np.einsum("tnh,tnl->hl", both, dl), "bias": dl.sum(axis=(0, 1)), "emb": np.zeros_like(w["emb"])}
        dboth = dl @ w["out"].T
        for d, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            gx, gu, gc = np.zeros((256, 3 * h), np.float32), np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"c{d}"])
            carry = np.zeros((len(y), h), np.float32)
            for i, state, z, r, new in reversed(kept[d]):
                dh = carry + dboth[i][:, cut]
                m = mask[i][:, None]
                dz, dn = dh * m * (new - state), dh * m * z
                carry = dh * (1 - m * z)
                dn *= 1 - new * new
                drs = dn @ w[f"c{d}"].T
                gc += (r * state).T @ dn
                carry += drs * r
                dg = np.concatenate((dz * z * (1 - z), drs * state * r * (1 - r)), axis=1)
                gu += state.T @ dg
                carry += dg @ w[f"u{d}"].T
                np.add.at(gx, x[i], np.concatenate((dg, dn), axis=1))
            grad |= {f"u{d}": gu, f"c{d}": gc, f"x{d}": w["emb"].T @ gx, f"a{d}": gx.sum(axis=0)}
            grad["emb"] += gx @ w[f"x{d}"].T
        return loss, grad

    def train(self, seqs: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.012, seed: int = 9) -> list[float]:
        """Adam with a falling rate."""
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(seqs), batch)
            loss, grad = self.gradient([seqs[i] for i in pick], y[pick])
            losses.append(loss)
            scale = min(1.0, 2.0 / (1e-6 + np.sqrt(sum(float((g * g).sum()) for g in grad.values()))))
            now = rate * (1 - 0.9 * t / steps)
            for k, g in grad.items():
                g = g * scale
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses


def training_words(docs: DataFrame, learn: Column, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> DataFrame:
    """lang and words of the sample. The rank keeps ``max_docs`` rows a language before anything is shuffled."""
    w = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            starts, codes, words = words_of(letters_only(part.column("text")))
            out = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = codes[starts[i] : starts[i + 1]]
                if len(own) > max_words:
                    own = own[np.random.default_rng(zlib.crc32(str(doc).encode())).choice(len(own), max_words, replace=False)]
                out.append([words[c] for c in own])
            yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "lang", "words"])

    few = ids.orderBy("_r", "lang").limit(MAX_TOTAL).select("doc_id", "lang")  # the bound lets it be broadcast
    taken = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return taken.mapInArrow(run, "doc_id long, lang string, words array<string>")


def fit(docs: DataFrame, learn: Column, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, steps: int = STEPS) -> Network | None:
    """None if there is nothing to learn from."""
    rows = training_words(docs, learn, max_docs, max_words).orderBy("doc_id", "lang", "words").collect()  # max_docs rows a language
    langs = sorted({r["lang"] for r in rows})
    pairs = [(p, langs.index(r["lang"])) for r in rows for word in r["words"] for p in pieces(word)]
    if not pairs:
        return None
    net, y = Network.fresh(langs), np.array([t for _, t in pairs])
    if len(langs) > 1:
        rng = np.random.default_rng(3)
        by = [np.flatnonzero(y == t) for t in range(len(langs))]
        even = np.concatenate([rng.choice(b, max(map(len, by))) for b in by if len(b)])  # languages weigh the same
        net.train([pairs[i][0] for i in even], y[even], steps)
    return net


class Labeller:
    """Runs the network on distinct words and keeps their summed distributions."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known = HashIndex()
        self.sums, self.sizes = np.zeros((0, len(self.net.langs)), np.float32), np.zeros(0, np.float32)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean label distribution of every text and its number of labelled bytes."""
        starts, codes, words = words_of(letters_only(text))
        if len(self.known) + len(words) > CACHE_WORDS:
            self.clear()
        hashes = word_hashes(words)
        fresh = [i for i in np.flatnonzero(self.known.find(hashes) < 0).tolist() if words[i]]
        if fresh:
            cut = [pieces(words[i]) for i in fresh]
            many = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
            sums = segment_sums(self.net.label([p for c in cut for p in c]), many)
            self.known.add(hashes[fresh])
            self.sums = np.concatenate((self.sums, sums.astype(np.float32)))
            self.sizes = np.concatenate((self.sizes, np.array([sum(map(len, c)) for c in cut], np.float32)))
        where = self.known.find(hashes)[codes] if len(codes) else np.zeros(0, np.int64)
        if not len(where):
            return np.zeros((len(starts) - 1, len(self.net.langs))), np.zeros(len(starts) - 1)
        size = segment_sums(self.sizes[where], starts)
        return segment_sums(self.sums[where], starts) / np.maximum(size, 1)[:, None], size


def labeller(net: Network) -> Labeller:
    return keep(("labeller", zlib.crc32(net.weights["out"].tobytes())), lambda: Labeller(net))


def predict(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    letter = unused("_letter", docs.columns)
    marked = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = marked.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        langs = np.array([*shared.value.langs, "und"], object)
        for part in text_slices(batches, text_col):
            p, size = label(part.column(text_col))
            known = part.column(letter).to_numpy(zero_copy_only=False) & (size > 0)
            best = np.where(known, p.argmax(axis=1), len(langs) - 1)
            score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([*part.columns, pa.array(langs[best].tolist(), pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "lang_score"])

    return marked.mapInArrow(run, schema).drop(letter)
