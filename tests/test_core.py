"""The change-log engine: newest wins, scans, store, compaction, sketches, integrity, sequential state, codecs and streams."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lodestrata.functions import bloom, countmin, hll
from lodestrata.functions.hashing import fnv1a64, trailing_zeros
from lodestrata.operators import compaction, latest, merkle, scan, sequential, simhash
from lodestrata.plans import catalog
from lodestrata.schema import KV_SCHEMA, EngineOptions, check_user_key, is_reserved
from lodestrata.sources import codec
from lodestrata.sources.limiter import LimitedStore, RateLimited
from lodestrata.sources.registry import SketchRegistry
from lodestrata.sources.store import KVStore
from lodestrata.sources.wal import WriteAheadLog
from lodestrata.streaming import changelog

SF = "/root/testdata/sf0.001"
rng_keys = random.Random(41)
KEYS = sorted({"".join(rng_keys.choice("mnop") for _ in range(rng_keys.randint(2, 5))) for _ in range(24)})  # many shared prefixes


def log(spark, rows):
    return spark.createDataFrame([(k, v, t, i, v is None) for i, (k, v, t) in enumerate(rows)], KV_SCHEMA)


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda d: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_replay_equals_a_dict(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(12)}", None if rng.random() < 0.3 else str(i), rng.randrange(20)) for i in range(200)]
    state = {}
    for i, (k, v, t) in enumerate(rows):
        if k not in state or (t, i) > state[k][:2]:
            state[k] = (t, i, v)
    assert pairs(latest.live(log(spark, rows))) == {k: v for k, (_, _, v) in state.items() if v is not None}


def test_empty_value_is_absent(spark):
    assert pairs(latest.live(log(spark, [("a", "1", 1), ("a", "", 2), ("b", "2", 1)]))) == {"b": "2"}


def test_scans_and_pages(spark):
    df = log(spark, [(k, f"of {k}", 1) for k in reversed(KEYS)])
    keys = lambda rows: [r["key"] for r in rows.orderBy("key").collect()]
    for prefix in ("", "m", KEYS[3][:2], "zz"):
        assert keys(scan.prefix_rows(df, prefix)) == [k for k in KEYS if k.startswith(prefix)]
    for low, high in ((KEYS[2], KEYS[9]), (KEYS[2] + "a", "o"), ("z", "a")):
        assert keys(scan.range_rows(df, low, high)) == [k for k in KEYS if low <= k <= high]
    paged = [r["key"] for n in range(1, len(KEYS) // 4 + 2) for r in scan.prefix_scan(df, "", n, 4).collect()]
    assert paged == KEYS
    assert scan.prefix_scan(df, "", 99, 4).count() == 0
    with pytest.raises(ValueError):
        scan.page(df, 0, 4)
    assert scan.floor_key(df, KEYS[5] + "!").first()["key"] == KEYS[5]
    assert scan.floor_key(df, "a").first()["key"] is None


def test_iterator(spark):
    it = scan.prefix_iterate(log(spark, [("b", "1", 1), ("a", "1", 1), ("c", None, 1)]), "")
    assert it.has_next() and it.next()["key"] == "a"
    it.stop()
    assert not it.has_next() and it.next() is None
    it.reset()
    assert [r["key"] for r in it] == ["a", "b"]


@pytest.mark.parametrize("bottom", [True, False])
def test_merge_equals_a_dict(spark, bottom):
    rng = random.Random(11)
    runs, state = [], {}
    for t in range(4):
        rows = {f"k{rng.randrange(20):02}": None if rng.random() < 0.3 else f"{t}-{rng.randrange(99)}" for _ in range(9)}
        runs.append(log(spark, [(k, v, t) for k, v in rows.items()]))
        state |= rows
    merged = pairs(compaction.merge_runs(runs, bottom))
    assert merged == ({k: v for k, v in state.items() if v is not None} if bottom else state)


def test_read_order_and_bounds(spark):
    placed = spark.createDataFrame([(1, 4), (0, 2), (0, 5), (2, 1)], "level int, generation long")
    assert [(r["level"], r["generation"]) for r in compaction.read_order(placed).orderBy("place").collect()] == [(0, 5), (0, 2), (1, 4), (2, 1)]
    runs = [{"level": 0, "low": "d", "high": "h"}, {"level": 1, "low": "a", "high": "c"}, {"level": 1, "low": "h", "high": "k"}, {"level": 2, "low": "a", "high": "z"}]
    assert compaction.leveled_inputs(runs, 0, 1) == [runs[0], runs[2]] and compaction.leveled_inputs(runs, 3, 4) == []


@pytest.mark.parametrize("kind", ["size", "leveled"])
def test_store_equals_a_dict(spark, tmp_path, kind):
    """Random single writes, appended batches, flushes, merges and restarts, against a dictionary."""
    rng = random.Random(19)
    options, path = EngineOptions(run_rows=3, merge_threshold=2, max_levels=3, compaction=kind, cache_size=2), f"file://{tmp_path}/kv"
    store, state = KVStore(spark, path, options), {}
    for t in range(14):
        key = f"k{rng.randrange(6)}"
        if t == 7:
            batch = {f"k{rng.randrange(9)}": f"batch{i}" for i in range(4)}
            store.append(spark.createDataFrame([(k, v, t, 100 + i, False) for i, (k, v) in enumerate(batch.items())], KV_SCHEMA))
            state |= batch
        elif rng.random() < 0.3:
            store.delete(key, ts=t)
            state.pop(key, None)
        else:
            store.put(key, f"v{t}", ts=t)
            state[key] = f"v{t}"
        if t == 10:
            store = KVStore(spark, path, options)  # what was not flushed comes back from the log
        found = store.get(key)
        assert (found and found[0]) == state.get(key), t
    assert pairs(store.live()) == state
    assert [r["key"] for r in store.prefix_scan("k", 1, 99).collect()] == sorted(state)
    levels = {r["level"] for r in store.manifest()["runs"]}
    assert levels and max(levels) > 0
    if kind == "leveled":
        runs = sorted((r["low"], r["high"]) for r in store.manifest()["runs"] if r["level"] == 1)
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    store.flush()
    assert not store.memory and pairs(store.live()) == state and store.flush() is None
    store.clear()
    assert store.live().count() == 0 and not list(tmp_path.glob("kv/level=*/generation=*")) and not list(tmp_path.glob("kv/merkle/*"))


def test_store_gives_back_the_newest_by_time(spark, tmp_path):
    store = KVStore(spark, f"file://{tmp_path}/kv", EngineOptions(run_rows=2))
    store.put("x", "late", ts=9)
    store.put("y", "1", ts=1)  # flushed with it
    store.put("x", "early", ts=3)  # in memory, but older
    assert store.get("x") == ("late", 0) and store.log(-1).count() == 1
    for bad in ("", "bf_x", "token_bucket_state"):
        with pytest.raises(ValueError):
            store.put(bad, "1")
    with pytest.raises(ValueError):
        store.put("z", "")


def test_cache_answers_until_a_write(spark, tmp_path):
    store = KVStore(spark, f"file://{tmp_path}/kv")
    store.put("a", "1", ts=1)
    assert store.get("a") == ("1", -1) and store.recent.get("a") == (True, ("1", -1))
    store.put("a", "2", ts=2)
    assert store.get("a") == ("2", -1)
    assert store.get("none") is None and store.recent.get("none") == (True, None)


def test_trees_find_damage(spark, tmp_path):
    store = KVStore(spark, f"file://{tmp_path}/kv", EngineOptions(trees=True))
    rows = [(f"k{i:02}", f"v{i}", 1, i, False) for i in range(21)]
    g = store.append(spark.createDataFrame(rows, KV_SCHEMA))
    assert store.validate(g).count() == 0 and store.validate(g, None).count() == 0
    damaged = spark.createDataFrame([(k, "other" if s == 6 else v, t, s, d) for k, v, t, s, d in rows], KV_SCHEMA)
    damaged.write.mode("overwrite").parquet(store._run_path(0, g))
    assert [r["idx"] for r in store.validate(g).collect()] == [6]
    assert {(r["level"], r["idx"]) for r in store.validate(g, None).collect()} == {(n, 6 >> n) for n in range(6)}


def test_rate_limit(spark, tmp_path):
    now = [100.0]
    base, options = f"file://{tmp_path}/kv", EngineOptions(bucket_capacity=3, bucket_reset_ms=1000, run_rows=50)
    limited = LimitedStore(KVStore(spark, base, options), lambda: now[0])
    limited.put("a", "1")
    limited.delete("b")
    assert limited.get("a")[0] == "1"
    for f in (lambda: limited.put("c", "1"), lambda: limited.get("a"), lambda: limited.prefix_scan("", 1, 1)):
        with pytest.raises(RateLimited):
            f()
    again = LimitedStore(KVStore(spark, base, options), lambda: now[0])  # a restart does not fill the bucket
    assert not again.take()
    now[0] += 1.0
    assert [again.take() for _ in range(4)] == [True, True, True, False]
    assert again.store.get("c") is None


def test_wal_positions_and_rotation(spark, tmp_path):
    wal = WriteAheadLog(spark, f"file://{tmp_path}/wal", segment_blocks=2)
    entries = [codec.Entry(f"k{i}".encode(), b"x" * 1500, i, False) for i in range(9)]
    for e in entries[:5]:
        wal.append(e)
    at = wal.rotate()
    for e in entries[5:]:
        wal.append(e)
    again = WriteAheadLog(spark, f"file://{tmp_path}/wal", segment_blocks=2)
    assert len(again.segments()) > 2 and again.read() == entries and again.read(at) == entries[5:]
    assert [r["key"] for r in again.replay(at).orderBy("seq").collect()] == [e.key.decode() for e in entries[5:]]
    again.truncate(at)
    assert again.read() == entries[5:]
    again.append(entries[0])
    assert again.read()[-1] == entries[0]


def test_reserved(spark):
    found = spark.createDataFrame([("bf_a",), ("sh_",), ("token_bucket_state",), ("user",)], "k string").select(is_reserved(F.col("k")).alias("r")).collect()
    assert [r["r"] for r in found] == [True, True, True, False]
    check_user_key("user")


def test_bloom(spark):
    items = spark.createDataFrame([(k,) for k in [*KEYS, None]], "x string")
    m, k = bloom.parameters(400, 0.01)
    bits = bloom.build(items, "x", m, k)
    assert all(r["maybe"] for r in bloom.membership(items, "x", bits, m, k).collect())
    absent = spark.createDataFrame([(f"absent{i}",) for i in range(200)], "x string")
    assert bloom.membership(absent, "x", bits, m, k).filter("maybe").count() < 5
    assert abs(bloom.estimated_cardinality(bits, m, k).first()["estimate"] - len(KEYS)) <= 1
    two = bits.selectExpr("'a' as f", "bit").unionByName(bits.selectExpr("'b' as f", "bit"))
    assert abs(bloom.expected_elements(two, "f", m, k).first()["expected"] - 2 * len(KEYS)) <= 2
    with pytest.raises(ValueError):
        bloom.parameters(10, 1.0)


def test_registry(spark, tmp_path):
    reg = SketchRegistry(KVStore(spark, f"file://{tmp_path}/reg", EngineOptions(merge_threshold=99)))
    items = spark.createDataFrame([("x",), ("y",), ("x",)], "v string")
    reg.create_bloom("b", 100, 0.01)
    reg.create_countmin("c", 0.01, 0.01)
    reg.create_hll("h", 8)
    for kind, name in (("bloom", "b"), ("countmin", "c"), ("hll", "h")):
        reg.add(kind, name, items, "v")
    assert reg.contains("b", "x") and not reg.contains("b", "zzz")
    assert reg.frequency("c", "x") >= 2 and reg.frequency("c", "y") >= 1
    assert 0 < reg.cardinality("h") < 10
    words = [" ".join(random.Random(seed).choices(KEYS, k=30)) for seed in (1, 2)]
    reg.create_simhash("s", words[0])
    reg.create_simhash("t", words[0])
    reg.create_simhash("u", words[1])
    assert reg.distance("s", "t") == 0 and reg.distance("s", "u") > 0
    reg.delete("bloom", "b")
    with pytest.raises(KeyError):
        reg.contains("b", "x")


def test_states_round_trip():
    b = bloom.BloomState(100, 3)
    b.set_bits([1, 50, 99])
    assert bloom.BloomState.from_bytes(b.to_bytes()).has_bits([1, 50, 99])
    c = countmin.CountMinState(10, 2)
    c.add([(0, 3, 5), (1, 7, 5)])
    assert countmin.CountMinState.from_bytes(c.to_bytes()).query([(0, 3), (1, 7)]) == 5
    h = hll.HllState(4)
    h.update([(2, 9)])
    assert hll.HllState.from_bytes(h.to_bytes()).regs[2] == 9


def test_merged_sketches_equal_the_whole(spark):
    rows = spark.range(200).select((F.col("id") % 37).cast("string").alias("x"))
    a, b = rows.limit(90), rows.exceptAll(rows.limit(90))
    whole = {tuple(r) for r in countmin.build(rows, "x", 50, 3).select("row", "bucket", "cnt").collect()}
    assert {tuple(r) for r in countmin.merge(countmin.build(a, "x", 50, 3), countmin.build(b, "x", 50, 3)).select("row", "bucket", "cnt").collect()} == whole
    assert all(r["estimate"] >= 5 for r in countmin.estimate(rows, "x", countmin.build(rows, "x", 50, 3), 50, 3).collect())
    regs = {tuple(r) for r in hll.registers(rows, "x", 6).collect()}
    assert {tuple(r) for r in hll.merge(hll.registers(a, "x", 6), hll.registers(b, "x", 6)).collect()} == regs


def test_fnv(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for byte in s.encode():
            h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
        return h - (1 << 64) if h >> 63 else h

    words = ["", "x7", "two words", "ž漢", "u" * 3000]
    got = spark.createDataFrame([(w,) for w in words], "x string").select(fnv1a64(F.col("x")).alias("h")).collect()
    assert [r["h"] for r in got] == [plain(w) for w in words]
    values = [0, 1, 8, -(1 << 63), -2]
    zeros = spark.createDataFrame([(v,) for v in values], "h long").select(trailing_zeros(F.col("h")).alias("z")).collect()
    assert [r["z"] for r in zeros] == [64, 0, 3, 63, 1]


def brute_print(text):
    """The fingerprint by the definition, bit by bit; None without tokens."""
    counts = Counter(t for t in (x.strip() for x in text.split(" ")) if t)
    sums = [sum(n if hashlib.md5(t.encode()).digest()[i // 8] >> 7 - i % 8 & 1 else -n for t, n in counts.items()) for i in range(128)]
    return bytes(sum((sums[8 * j + b] > 0) << b for b in range(8)) for j in range(16)).hex() if counts else None


def test_simhash(spark):
    rng = random.Random(23)
    texts = [" ".join(rng.choices(KEYS, k=rng.randint(1, 400))) + rng.choice(["", " ", "\n", "\u3000 x"]) for _ in range(12)] + ["", "  ", None, KEYS[0] * 3000, "w " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = {(r["doc_id"], r["token"]): r["n"] for r in simhash.token_counts(docs).collect()}
    assert counted == {(i, t): n for i, x in enumerate(texts) if x for t, n in Counter(t for t in (y.strip() for y in x.split(" ")) if t).items()}
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(docs).collect()}
    assert found == {i: p for i, x in enumerate(texts) if x and (p := brute_print(x))}
    bits = simhash.fingerprints(docs).select("fingerprint", simhash.bit_string(F.col("fingerprint")).alias("b")).collect()
    assert all(int(r["b"], 2) == int(r["fingerprint"], 16) and len(r["b"]) == 128 for r in bits)


def test_near_pairs_against_all_pairs(spark):
    rng, prints = random.Random(5), []
    for i in range(60):
        base = rng.getrandbits(128) if i % 6 == 0 else int(prints[-1][1], 16)
        for _ in range(rng.randrange(4) if i % 6 else 0):
            base ^= 1 << rng.randrange(128)
        prints.append((i, f"{base:032x}"))
    df = spark.createDataFrame(prints, "doc_id long, fingerprint string")
    rep = {}
    for i, p in prints:
        rep.setdefault(p, i)
    for d in (0, 3, 8):
        want = {(i, j, n) for p, i in rep.items() for q, j in rep.items() if i < j and (n := (int(p, 16) ^ int(q, 16)).bit_count()) <= d}
        assert {tuple(r) for r in simhash.near_pairs(df, d).collect()} == want
    assert {tuple(r) for r in simhash.representatives(df).select("doc_id", "rep").collect()} == {(i, rep[p]) for i, p in prints}
    with pytest.raises(ValueError):
        simhash.near_pairs(df, 15)


def test_merkle(spark):
    run = spark.createDataFrame([(f"k{i:03}", f"v{i}") for i in range(11)], "key string, value string")
    tree = merkle.build(merkle.leaves(run, F.encode(F.concat("key", "value"), "utf-8")))
    hashes = [zlib.crc32(f"k{i:03}v{i}".encode()) for i in range(11)]
    while len(hashes) > 1:
        hashes = [zlib.crc32(hashes[i].to_bytes(4, "little") + (hashes[i + 1] if i + 1 < len(hashes) else 0).to_bytes(4, "little")) for i in range(0, len(hashes), 2)]
    assert merkle.root(tree).first()["root"] == hashes[0]
    other = merkle.build(merkle.leaves(run.filter("key < 'k010'").withColumn("value", F.when(F.col("key") == "k003", "x").otherwise(F.col("value"))), F.encode(F.concat("key", "value"), "utf-8")))
    assert {r["idx"] for r in merkle.diff(tree, other).collect()} == {3, 10}


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 2100])
def test_merkle_of_any_size(spark, n, monkeypatch):
    """Blocks are folded four levels at a time here, so trees of these sizes take several steps."""
    monkeypatch.setattr(merkle, "FOLD", 4)
    hashes = [(i * 2654435761) % (1 << 32) for i in range(n)]
    bottom = spark.createDataFrame([(0, i, h) for i, h in enumerate(hashes)], "level int, idx long, hash long")
    want, level = {}, 0
    while hashes:
        want |= {(level, i): h for i, h in enumerate(hashes)}
        if len(hashes) == 1:
            break
        hashes = [zlib.crc32(hashes[i].to_bytes(4, "little") + (hashes[i + 1] if i + 1 < len(hashes) else 0).to_bytes(4, "little")) for i in range(0, len(hashes), 2)]
        level += 1
    tree = merkle.build(bottom)
    assert {(r["level"], r["idx"]): r["hash"] for r in tree.collect()} == want
    if n:
        data = merkle.to_bytes(tree)
        assert {(r["level"], r["idx"]): r["hash"] for r in merkle.from_bytes(spark, data).collect()} == want
        with pytest.raises(ValueError):
            merkle.from_bytes(spark, data[:9] + bytes([data[9] ^ 1]) + data[10:])


def walked(times, capacity, reset_us):
    """The bucket by its definition, request by request."""
    tokens, since, out = capacity, None, []
    for t in times:
        if t is None:
            out.append((False, 0))
            continue
        if since is None:
            since = t
        elif t - since >= reset_us:
            tokens, since = capacity, t
        out.append((tokens >= 1, max(tokens - 1, 0)))
        tokens = max(tokens - 1, 0)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 4), st.integers(1, 25), st.integers(0, 39))
def test_bucket_steps_equal_the_walk(times, capacity, reset, cut):
    times = sorted(times)
    allowed, left, tokens, since = sequential.bucket_steps(np.array(times[:cut], np.int64), np.ones(len(times[:cut]), bool), capacity, reset, capacity, None)
    more, rest, *_ = sequential.bucket_steps(np.array(times[cut:], np.int64), np.ones(len(times[cut:]), bool), capacity, reset, tokens, since)
    assert [*zip([*allowed, *more], [*left, *rest], strict=True)] == walked(times, capacity, reset)


def test_token_bucket(spark):
    """Null and NaN entities, null times, entities longer than an Arrow batch, and names that must not be touched."""
    rng = random.Random(13)
    rows = [(rng.choice([None, float("nan"), 1.0, 2.0]), rng.choice([None, *range(50)]), i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "who double, at long, n int, _x string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["n"]: (r["allowed"], r["tokens_left"]) for r in sequential.token_bucket(df.withColumn("at", F.col("at") * 1000), 3, 10, "who", "at", ["at", "n"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    for who in {str(r[0]) for r in rows}:
        own = sorted((r for r in rows if str(r[0]) == who), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == walked([r[1] for r in own], 3, 10)
    with pytest.raises(ValueError):
        sequential.token_bucket(df.withColumn("allowed", F.lit(1)), 3, 10, "who", "at")
    with pytest.raises(ValueError):
        sequential.token_bucket(df, 3, 10, "who", "at", ["n"])


def test_lru(spark):
    rng, kept, want = random.Random(31), [], []
    rows = [(0, rng.choice("pqrstu"), i, rng.choice(["put", "get", "remove"])) for i in range(80)]
    for _, k, _, op in rows:
        want.append(k in kept)
        if k in kept and op in ("put", "get", "remove"):
            kept.remove(k)
            kept.append(k)
        elif op == "put":
            kept = [*kept, k][-3:]
    acc = spark.createDataFrame(rows, "cache int, key string, seq long, op string")
    assert [r["hit"] for r in sequential.lru_simulation(acc, 3, op="op").orderBy("seq").collect()] == want
    assert sequential.lru_simulation(acc.limit(0), 3).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.one_of(st.binary(max_size=40), st.just(b"x" * 9000)), st.integers(0, 2**40), st.booleans()), max_size=12))
def test_codec(rows):
    entries = [codec.Entry(*r) for r in rows]
    blocks = b"".join(codec.pack(entries))
    assert len(blocks) % 4096 == 0 and list(codec.unpack(blocks)) == entries


def test_codec_finds_damage():
    data = bytearray(b"".join(codec.pack([codec.Entry(b"k", b"v", 1, False)])))
    data[20] ^= 1
    with pytest.raises(codec.Corrupt):
        list(codec.unpack(bytes(data)))


@given(st.integers(-(2**63), 2**63 - 1), st.booleans(), st.binary(max_size=300), st.binary(max_size=300))
def test_varints_and_headers(n, dead, key, value):
    assert codec.read_zigzag(codec.zigzag(n)) == (n, len(codec.zigzag(n))) and len(codec.zigzag(n)) <= 10
    assert codec.read_uvarint(codec.uvarint(abs(n))) == (abs(n), len(codec.uvarint(abs(n))))
    head = codec.encode_header(codec.Entry(key, value, n, dead))
    assert codec.decode_header(b"pad" + head, 3) == (n, dead, len(key), 0 if dead else len(value), 3 + len(head))


def test_read_log(spark, tmp_path):
    (tmp_path / "wal2.bin").write_bytes(b"".join(codec.pack([codec.Entry(b"a", b"1", 1, False)])))
    (tmp_path / "wal10.bin").write_bytes(b"".join(codec.pack([codec.Entry(b"a", b"2", 1, False)])))
    assert pairs(latest.live(codec.read_log(spark, f"file://{tmp_path}/wal*.bin"))) == {"a": "2"}


def test_stream(spark, tmp_path):
    store = KVStore(spark, f"file://{tmp_path}/store")
    for name, rows in (("one", [("a", "1", 1), ("b", "2", 1)]), ("two", [("c", "3", 1), ("a", None, 2)])):
        log(spark, rows).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        for _ in range(2):  # the second run finds nothing new; the second stream counts its batches from 0 again
            changelog.append_stream(changelog.read_stream(spark, f"file://{tmp_path}/{name}"), store, f"file://{tmp_path}/ck-{name}").awaitTermination()
    assert pairs(store.live()) == {"b": "2", "c": "3"} and store.log().count() == 4
    assert len(store.manifest()["offsets"]) == 2


def test_limit_stream(spark, tmp_path):
    """Requests of two micro-batches, in chunks smaller than an entity's rows and in no order."""
    rng, schema = random.Random(17), "key string, ts_us long, n int"
    first = [(rng.choice("ab"), rng.randrange(0, 40), i) for i in range(60)]
    second = [(rng.choice("ab"), rng.randrange(40, 90), 100 + i) for i in range(60)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        out = changelog.limit_stream(requests.withColumn("ts_us", F.col("ts_us") * 1000), 4, 10)
        out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    got = spark.table("limited").toPandas()
    for who in "ab":
        times = sorted(r[1] for r in first + second if r[0] == who)
        own = got[got.key == who].sort_values(["ts_us"])
        want = walked(times, 4, 10)
        assert sorted(zip(own.ts_us // 1000, own.allowed, strict=True)) == sorted(zip(times, [a for a, _ in want], strict=True))
    with pytest.raises(ValueError):
        changelog.limit_stream(requests.withColumn("allowed", F.lit(True)), 1, 1)


def test_options(tmp_path):
    EngineOptions(cache_size=7).save(tmp_path / "o.json")
    assert EngineOptions.load(tmp_path / "o.json").cache_size == 7
    for bad in ({"bloom_fp": 1}, {"run_rows": 0}, {"compaction": "none"}):
        with pytest.raises(ValueError):
            EngineOptions(**bad)
