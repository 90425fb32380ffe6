"""Token ids as length-delimited binary records with a separate offset index.

Record: length u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32 | newline. Payload: flag u8
(1: the id is null) | doc_id i64 | tokens before it in the shard u64 | tokens n u64 | bytes per id u8 | n ids; little-endian. The mask turns the
checksum by 15 bits and adds a constant, so that a checksum stored inside data is not taken for one of the data.

Documents are dealt by range of doc_id and, inside an id, of a hash of the text, so shard files in name order hold ascending ids, and many rows of one id, or
without one, are spread over shards. Records go through Spark's own text writer
(raw bytes, newline as the record end): its commit protocol keeps files whole when executors are lost or tasks run twice, on
any file system Spark can write.

Encoding: a tokenizer that provably takes a text word by word is run once per distinct word (``WordEncoder``); with any other whole texts are encoded.

Defined cases: a null or empty text is the end id alone; a null id sorts first; rows that repeat an id all stay, ordered by a hash of the text;
an empty table gives no records; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HashIndex, Scratch, give_back, keep, ragged, text_slices, word_hashes, words_of

MASK = 0xA282EAD8  # fixed value
HEAD = "<BqQQB"
SHARD_BYTES = 16 << 20
ENCODE_BYTES = 1 << 20
CACHE_WORDS = 2_000_000
JOIN_WORDS = 500
GATHER_WORDS = 50_000
SHARDS = 4096

INDEX_SCHEMA = "doc_id long, shard int, offset long, length long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


class Damaged(ValueError):
    """A record whose checksum or length is wrong."""


def read_frame(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at a byte and the place after it."""
    if at + 12 > len(data):
        raise Damaged(f"cut off at byte {at}")
    (n,) = struct.unpack_from("<Q", data, at)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(bytes(data[at : at + 8])) or at + 17 + n > len(data):
        raise Damaged(f"bad length at byte {at}")
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload) or data[at + 16 + n] != 10:
        raise Damaged(f"bad payload at byte {at}")
    return payload, at + 17 + n


# The settings of a tokenizer whose ids of a text are those of its words in turn. Normalisation neither joins nor parts words at white space, the
# pattern lower-cases, parts letters from signs and matches no white space, and nothing depends on a match's neighbours.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(spec: str) -> bool:
    """Whether a tokenizer's ids of a text are provably those of its words: only for the settings above, a plain BPE model, and added tokens that hold no white space
    and take none with them."""
    d = json.loads(spec)
    plain = d["model"].get("type") == "BPE" and not d["model"].get("dropout") and not d.get("truncation") and not d.get("padding")
    added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not any(c.isspace() for c in a["content"]) for a in d.get("added_tokens", []))
    return plain and added and d.get("normalizer") == NORMALIZER and d.get("pre_tokenizer") == PRE_TOKENIZER


class TextEncoder:
    """Encodes whole texts, one at a time."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def each(self, text: pa.Array) -> Iterator[np.ndarray]:
        for t in text:
            yield np.array(self.tokenizer.encode(t.as_py() or "", add_special_tokens=False).ids, f"<u{self.width}")


class WordEncoder:
    """Encodes texts word by word, for tokenizers that pass ``by_words``. The tokenizer splits at ASCII white space before anything else, so a text's ids are those of its
    words in turn; distinct words are encoded once, joined by spaces, and kept under 64-bit hashes up to a bound on their number. It lower-cases and parts
    letters from signs, so words of ASCII letters share an entry whatever their case and a last sign."""

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_str(spec), cache_words
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.signs = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in ".,;:!?"}
        self.clear()

    def clear(self) -> None:
        self.known = HashIndex()
        self.starts, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, f"<u{self.width}"), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has."""
        ids, counts = [], []
        for i in range(0, len(words), JOIN_WORDS):
            part = words[i : i + JOIN_WORDS]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in part])
            offsets = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            counts.append(np.bincount(np.searchsorted(begins, offsets, side="right") - 1, minlength=len(part)))
            ids.append(np.array(found.ids, f"<u{self.width}"))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        stems: dict[str, int] = {}
        own, last = np.empty(len(words), np.int64), np.full(len(words), -1)
        for i, w in enumerate(words):
            stem = w
            if w.isascii():
                if w.isalpha():
                    stem = w.lower()
                elif w[-1] in self.signs and w[:-1].isalpha() and len(self.signs[w[-1]]) == 1:
                    stem, last[i] = w[:-1].lower(), self.signs[w[-1]][0]
            own[i] = stems.setdefault(stem, len(stems))
        ids, counts = self._encode(list(stems))
        begins = np.cumsum(counts) - counts
        length = counts[own]
        total = length + (last >= 0)
        ends = np.cumsum(total)
        new = np.empty(int(ends[-1]), ids.dtype)
        new[ragged(ends - total, length)] = ids[ragged(begins[own], length)]
        new[ends[last >= 0] - 1] = last[last >= 0]
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(new)] = new
        self.starts = np.concatenate((self.starts, self.used + ends))
        self.used += len(new)
        self.known.add(hashes)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin (one more than texts)."""
        found = list(self.each(text))
        return np.concatenate([self.ids[:0], *found]), np.cumsum([0] + [len(ids) for ids in found])

    def each(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in turn. They are gathered for GATHER_WORDS words at a time, or one text, which bounds what a slice holds beside its words."""
        starts, codes, words = words_of(text)
        if not len(codes):
            yield from (self.ids[:0] for _ in range(len(text)))
            return
        if len(self.known) + len(words) > self.cache_words:
            self.clear()
        hashes = word_hashes(words)
        place = self.known.find(hashes)
        unseen = [i for i in np.flatnonzero(place < 0).tolist() if words[i]]
        if unseen:
            place[unseen] = len(self.known) + np.arange(len(unseen))
            self._learn([words[i] for i in unseen], hashes[unseen])
        del words, hashes, unseen
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + GATHER_WORDS, side="right")) - 1)
            where = place[codes[starts[at] : starts[end]]]
            length = self.starts[where + 1] - self.starts[where]
            ends = np.concatenate(([0], np.cumsum(length)))
            ids, cuts = self.ids[ragged(self.starts[where], length)], ends[starts[at : end + 1] - starts[at]]
            yield from (ids[a:b] for a, b in pairwise(cuts.tolist()))
            at = end


def encoder(spec: str) -> WordEncoder | TextEncoder:
    """One per Python worker, kept between tasks."""
    return keep(("encoder", zlib.crc32(spec.encode())), lambda: WordEncoder(spec) if by_words(spec) else TextEncoder(spec))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Writes records to ``path``/records and their index to ``path``/index. Memory per task is one slice of text and the word cache."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a fixed file of a few MB on the driver
        spec = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    keyed = docs.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(spec.value), 0
        last = np.array([end_id], f"<u{enc.width}").tobytes()
        for part in text_slices(batches, limit=ENCODE_BYTES):
            out = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.each(part.column("text")), strict=True):
                own = ids.tobytes() + last
                n = len(own) // enc.width
                out.append(frame(struct.pack(HEAD, doc is None, doc or 0, before, n, enc.width) + own))
                before += n
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
            del out
            give_back()

    framed = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # the cast keeps the bytes
    framed.write.mode("overwrite").option("compression", "none").option("lineSep", "\n").text(f"{path}/records")
    read_records(spark, path).write.mode("overwrite").parquet(f"{path}/index")


def _shard(name: str) -> int:
    """The number in a part file's name."""
    return int(name.rsplit("/", 1)[-1].split("-")[1])


def read_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every record of the shard files, checksums verified, with its place; ``ids`` only if asked for. A task holds one shard."""
    schema = INDEX_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, shard = memoryview(batch.column("content")[i].as_buffer()), _shard(batch.column("path")[i].as_py())
                rows, at = [], 0
                while at < len(data):
                    payload, end = read_frame(data, at)
                    rows.append(_row(payload, shard, at, end - at, with_ids))
                    at = end
                    if len(rows) == 2000:
                        yield _batch(rows, with_ids)
                        rows = []
                yield _batch(rows, with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")
    return files.mapInArrow(run, schema)


def _row(payload: memoryview, shard: int, at: int, length: int, with_ids: bool) -> tuple:
    null, doc, before, n, width = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, f"<u{width}", n, struct.calcsize(HEAD))
    row = (None if null else doc, shard, at, length, before, n, zlib.crc32(ids.astype("<u4").tobytes()))
    return (*row, ids.astype(np.int32)) if with_ids else row


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    if with_ids:
        names, columns = [*names, "ids"], [*columns, pa.array([r[7] for r in rows], pa.list_(pa.int32()))]
    return pa.record_batch(columns, names)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Shuffled reads: the ids of the records of ``wanted`` (doc_id), found through the index; a shard is read once for all of its records."""
    index = spark.read.parquet(f"{path}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")
    asked = index.groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("int")
    schema = INDEX_SCHEMA + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column("content")[i].as_buffer())
                rows = []
                for at in batch.column("offsets")[i].as_py():
                    payload, end = read_frame(data, at)
                    rows.append(_row(payload, batch.column("shard")[i].as_py(), at, end - at, True))
                yield _batch(rows, True)

    return files.withColumn("shard", number).join(asked, "shard").mapInArrow(run, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``, the tokens of all records before one: those before it in its shard and those of earlier shards. Running sums go over the shards of a block, and
    over one row per block of SHARDS shards."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("c")).withColumn("_block", F.floor(F.col("shard") / SHARDS))
    blocks = sums.groupBy("_block").agg(F.sum("c").alias("b"))
    before = blocks.select("_block", (F.sum("b").over(W.orderBy("_block")) - F.col("b")).alias("_before"))
    inside = F.sum("c").over(W.partitionBy("_block").orderBy("shard")) - F.col("c")
    base = sums.withColumn("_inside", inside).join(before, "_block").select("shard", (F.col("_inside") + F.col("_before")).alias("_base"))
    return index.join(base, "shard").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def encode_table(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the table and returns what the files hold: doc_id, start, n_tokens, ids_crc32 and the record's place."""
    spark = docs.sparkSession
    path = path or Scratch(spark, "tokens").path
    write(docs, path, tokenizer_path, end_id)
    found = with_starts(spark.read.parquet(f"{path}/index"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")
