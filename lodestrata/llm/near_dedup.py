"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles, as 64-bit hashes. Documents with equal sets form a class through a digest of the set, and only classes are
compared. A class has ``REGISTERS`` buckets, each with its own hash function; a bucket keeps the leading zeros of its least hash and the mantissa bits
that follow, 16 bits in all. Four registers make a band; classes that share a band are candidates.

Inside a band's group nothing is paired with everything: first each class meets the group's smallest one. Survivors of the collision-corrected estimate
are verified on the full sets, and components are formed. Groups that still hold several components are looked at again: each class meets the nearest
class of another component, and after another round of components the full sets go to the groups still mixed, where all pairs of different
components that the estimate lets through are verified in place and only links come out. So every candidate pair of the bands is either
verified or already connected. Groups too large for a task are cut into blocks that meet in pairs.

Documents that share a band but fail the estimate are apart by more than ``MARGIN`` standard deviations, which happens to a pair of similarity 0.8
with probability 3 in 100 million. Bands are missed by a pair of similarity 0.8
with probability (1 - 0.8^4)^32, or 5 in 100 million.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; with fewer words than a shingle has, all words are
one; rows that share an id are one document for linking if their sets are alike and otherwise both link under that id; a null id is never linked, its row
has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget, text_slices, word_hashes, words_of
from .components import connected
from .lm import U, mix64

REGISTERS, ROWS = 128, 4
MANTISSA = 10
MARGIN = 6.0
BLOCK = 4096
FILTER_BITS = 1 << 26
BROADCAST_IDS = 2_000_000  # 16 MB
RNG = np.random.default_rng(20_240_229)
ODD = RNG.integers(0, 1 << 63, REGISTERS, dtype=U) * U(2) + U(1)
XOR = RNG.integers(0, 1 << 63, REGISTERS, dtype=U) * U(2)
STEP = U(0x9DDFEA08EB382D69)


def shingles(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and the sorted distinct shingle hashes of every text."""
    starts, codes, words = words_of(text, lower=True)
    n = np.diff(starts)
    if not len(codes):
        return np.zeros(len(starts), np.int64), np.zeros(0, U)
    h = word_hashes(words)[codes]
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), many)
    first = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    size = np.minimum(n, k)[doc]
    out = mix64(size.astype(U) * STEP)
    for j in range(k):
        inside = size > j
        out[inside] = mix64(out[inside] * STEP + h[first[inside] + j])
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])))
    doc, out = doc[new], out[new]
    return np.searchsorted(doc, np.arange(len(n) + 1)), out


def registers(starts: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The compressed registers of non-empty sets, one row each."""
    out = np.empty((len(starts) - 1, REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((sets ^ XOR[i]) * ODD[i], starts[:-1]) >> U(11)  # 53 bits, exact as a double
        f, e = np.frexp(least.astype(np.float64))
        zeros = np.minimum(53 - e, 63)
        mantissa = np.where(least > 0, (f * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
        out[:, i] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m elements agree: per octave of the least hash the product of the two densities, times the
    width of a cell."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    total = np.zeros(np.broadcast(n, m).shape)
    s = np.maximum(n + m - 1, 1)
    for z in range(48):
        low, high = 2.0 ** -(z + 1), 2.0**-z
        mass = n * m / s * (np.exp(s * np.log1p(-low)) - (np.exp(s * np.log1p(-high)) if z else 0.0))
        total += mass * low / (1 << MANTISSA)
    return np.minimum(total, 0.5)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, less what collides by chance."""
    c = collision_rate(n, m)
    return np.clip((agree / REGISTERS - c) / (1 - c), 0, 1)


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)


SIGNED = "doc_id long, n long, cls long, regs binary"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, class digest and registers of every row; an empty set has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in text_slices(batches):
            starts, sets = shingles(part.column("text"), k)
            n = np.diff(starts)
            some = np.flatnonzero(n)
            cls = np.zeros(len(n), np.int64)
            regs = np.full(len(n), None, object)
            if len(some):
                own = starts[np.concatenate((some, [len(n)]))]
                cls[some] = mix64(np.add.reduceat(mix64(sets), own[:-1]) + n[some].astype(U) * STEP).view(np.int64)
                made = registers(own, sets)
                regs[some] = [r.tobytes() for r in made]
            yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(cls, mask=n == 0), pa.array(regs.tolist(), pa.binary())], ["doc_id", "n", "cls", "regs"])

    return docs.mapInArrow(run, SIGNED)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids, 8 MB whatever their number; it only spares work, so a full one costs time and nothing else."""
    pos = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("long")

    def fill(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, np.uint8)
        out[t.column("p").to_numpy() & 0xFFFF] = 1
        return pa.table({"seg": t.column("seg")[:1], "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    parts = ids.select(pos.alias("p")).distinct().withColumn("seg", F.shiftright("p", 16)).groupBy("seg").applyInArrow(fill, "seg long, bits binary").collect()
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        whole[r["seg"] * 8192 : (r["seg"] + 1) * 8192] = np.frombuffer(r["bits"], np.uint8)
    return whole


def sets_of(docs: DataFrame, needed: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """cls and full set of the classes in ``needed`` (cls, rep), made again from their representatives' texts and written once."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(needed, "rep"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            pos = part.column("p").to_numpy()
            maybe = bits.value[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1
            part = part.filter(pa.array(maybe.astype(bool)))
            if part.num_rows:
                starts, sets = shingles(part.column("text"), k)
                n = np.diff(starts)
                cls = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    own = starts[np.concatenate((some, [len(n)]))]
                    cls[some] = mix64(np.add.reduceat(mix64(sets), own[:-1]) + n[some].astype(U) * STEP).view(np.int64)
                out = [sets[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.record_batch([part.column("doc_id"), pa.array(cls), pa.array(out, pa.binary())], ["rep", "cls", "shingles"])

    hashed = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long").alias("p"))
    found = hashed.mapInArrow(pick, "rep long, cls long, shingles binary")
    wanted = found.join(needed.select("cls", "rep").distinct(), ["cls", "rep"], "left_semi")
    return scratch.save(wanted.dropDuplicates(["cls"]).select("cls", "shingles"), name)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union."""
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                keep.append(alike(x, y, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def passing(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose estimate allows the threshold."""
    side = lambda c, s: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")]
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = (estimate((regs[0] == regs[1]).sum(axis=1), n, m) >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").mapInArrow(run, "a long, b long")


def band_rows(classes: DataFrame) -> DataFrame:
    """cls, band, key: a band's key is its four registers, bit for bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // ROWS
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.int64)
                cls = np.repeat(batch.column("cls").to_numpy(), bands)
                yield pa.record_batch([pa.array(cls), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), pa.array(keys)], ["cls", "band", "key"])

    return classes.select("cls", "regs").mapInArrow(run, "cls long, band int, key long")


def across(groups: DataFrame, threshold: float, mode: str, percent: int = 80) -> DataFrame:
    """Looks at pairs of different components inside groups (band, key) of rows cls, n, regs, comp, g (group size). Only pairs that the estimate lets
    through count. What comes back depends on ``mode``:

    ``nearest``: pairs (a, b), for each class the nearest one of another component. ``involved``: rows (band, key, cls) of classes with such a
    pair whose first shared band this is. ``links``: pairs (a, b) verified on the full sets (column shingles), for each class and other
    component from the nearest on until one is found."""
    least = least_estimate(threshold)
    salt = F.pmod(F.xxhash64("cls"), F.ceil(F.col("g") / BLOCK)).cast("int")
    blocks = groups.withColumn("s", salt).withColumn("t", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("g") / BLOCK) - 1).cast("int"))))
    dealt = blocks.withColumns({"b1": F.least("s", "t"), "b2": F.greatest("s", "t")})

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        cls, comp, n, s = (t.column(c).to_numpy() for c in ("cls", "comp", "n", "s"))
        apart, band = t.column("b1")[0].as_py() != t.column("b2")[0].as_py(), t.column("band")[0].as_py()
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        comp = np.unique(comp, return_inverse=True)[1]
        largest = np.bincount(comp).argmax()
        minor = np.flatnonzero(comp != largest)  # pairs inside the largest component need no look
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(minor), 64):
            rows = minor[at : at + 64]
            ok = np.minimum(n[rows, None], n[None, :]) >= threshold * np.maximum(n[rows, None], n[None, :]) - 1e-9
            ok &= comp[rows, None] != comp[None, :]
            if apart:
                ok &= s[rows, None] != s[None, :]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            agree = np.concatenate([(regs[rows[i[x : x + 65536]]] == regs[j[x : x + 65536]]).sum(axis=1) for x in range(0, len(i), 65536)])
            est = estimate(agree, n[rows[i]], n[j])
            good = est >= least
            i, j, est = rows[i[good]], j[good], est[good]
            if mode != "nearest" and len(i):  # a pair belongs to the first band it shares, and is looked at from one side
                same = (regs[i].reshape(len(i), REGISTERS // ROWS, ROWS) == regs[j].reshape(len(j), REGISTERS // ROWS, ROWS)).all(axis=2)
                keep = (same.argmax(axis=1) == band) & ((comp[j] == largest) | (i < j))
                i, j, est = i[keep], j[keep], est[keep]
            if not len(i):
                continue
            order = np.lexsort((j, -est, i) if mode == "nearest" else (j, -est, comp[j], i))
            i, j = i[order], j[order]
            if mode == "nearest":
                new = np.concatenate(([True], i[1:] != i[:-1]))
                i, j = i[new], j[new]
            found.append((i, j))
        i, j = (np.concatenate([np.zeros(0, np.int64), *(f[side] for f in found)]).astype(np.int64) for side in (0, 1))
        if mode == "involved":
            own = np.unique(np.concatenate((i, j)))
            return pa.table({"band": pa.array([band] * len(own), pa.int32()), "key": pa.array([t.column("key")[0].as_py()] * len(own), pa.int64()), "cls": pa.array(cls[own], pa.int64())})
        if mode == "links":
            sets = [np.frombuffer(x.as_buffer(), U) for x in t.column("shingles")]
            linked: set[tuple[int, int]] = set()
            kept = []
            for x, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                if (a, comp[b]) not in linked and alike(sets[a], sets[b], percent):
                    linked.add((a, comp[b]))
                    kept.append(x)
            i, j = i[kept], j[kept]
        return pa.table({"a": pa.array(np.minimum(cls[i], cls[j]), pa.int64()), "b": pa.array(np.maximum(cls[i], cls[j]), pa.int64())})

    schema = "band int, key long, cls long" if mode == "involved" else "a long, b long"
    return dealt.groupBy("band", "key", "b1", "b2").applyInArrow(run, schema).distinct()


def unsettled(bands: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """The groups that hold several components: band, key, cls, comp, g, n, regs."""
    named = bands.join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "band", "key", F.coalesce("root", "cls").alias("comp"))
    mixed = named.groupBy("band", "key").agg(F.count("*").alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("g > 2 and lo <> hi").select("band", "key", "g")
    return named.join(mixed, ["band", "key"]).join(classes.select("cls", "n", "regs"), "cls")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept; one row per row of ``docs``."""
    spark, threshold = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(signatures(docs, k), "signed")
    linkable = signed.filter("cls is not null and doc_id is not null")
    grouped = linkable.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = scratch.save(grouped, "classes")
    bands = scratch.save(band_rows(classes), "bands")
    # one id may have several texts: their classes are linked outright
    same_id = linkable.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a <> z").select("doc_id", "a").join(linkable.select("doc_id", F.col("cls").alias("b")), "doc_id").select("a", "b").filter("a <> b")

    # every class meets the smallest one of its groups
    centre = bands.groupBy("band", "key").agg(F.min("cls").alias("a"), F.count("*").alias("g")).filter("g > 1")
    star = bands.join(centre, ["band", "key"]).filter("cls <> a").select(F.col("a"), F.col("cls").alias("b")).distinct()
    star = scratch.save(passing(star, classes, threshold), "star")
    ids = classes.select("cls", "rep")
    needed = lambda p: p.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(ids, "cls")
    sets = sets_of(docs, needed(star), k, scratch, "sets-0")
    links = scratch.save(verified(star, sets, percent).unionByName(same_id).distinct(), "links-0")
    comp = scratch.save(connected(links, scratch, "stars-a"), "comp-0")

    # groups that still hold several components: nearest classes first, then whatever is left
    mixed = scratch.save(unsettled(bands, classes, comp), "mixed-1")
    near = scratch.save(across(mixed, threshold, "nearest").join(star, ["a", "b"], "left_anti"), "pairs")
    sets = sets_of(docs, needed(near), k, scratch, "sets-1")
    links = scratch.save(links.unionByName(verified(near, sets, percent)), "links-1")
    comp = scratch.save(connected(links, scratch, "stars-b"), "comp-1")
    scratch.drop("sets-0", "sets-1", "mixed-1")
    mixed = scratch.save(unsettled(bands, classes, comp), "mixed-2")
    left = mixed.join(scratch.save(across(mixed, threshold, "involved"), "involved"), ["band", "key", "cls"], "left_semi")
    sets = sets_of(docs, left.select("cls").distinct().join(ids, "cls"), k, scratch, "sets-2")
    links = scratch.save(links.unionByName(across(left.join(sets, "cls"), threshold, "links", percent)), "links-2")
    comp = scratch.save(connected(links, scratch, "stars-c"), "comp-2")
    scratch.drop("sets-2", "mixed-2")

    named = classes.join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "comp").select("cls", "component_id")
    out = signed.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def few(ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The ids, written once, and broadcast if they are counted as few enough."""
    ids = scratch.save(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document of each component. Of rows with equal id and text one stays; a row without an id
    always does. Only rows whose id occurs more than once are compared by their texts."""
    scratch = Scratch(docs.sparkSession, "keep")
    gone = few(near_duplicates(docs, k, percent).filter("not kept and doc_id is not null").select("doc_id").distinct(), scratch, "gone")
    stay = docs.join(gone, "doc_id", "left_anti")
    again = few(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), scratch, "again")
    repeated = stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(again, "doc_id", "left_anti").unionByName(repeated)
