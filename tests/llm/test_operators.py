"""Operators on small fixtures: brute force, round trips, held-out accuracy, and the cases every operator must define."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import common, decontaminate, language, lm, mixing, near_dedup, neighbours, queries, substring_dedup, token_records, toxicity, url_filters
from lodestrata.llm.common import Scratch, fold
from lodestrata.llm.components import connected

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, cls string, row int, size string, copies int, toxicity string, rid int, h int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(80))
    rows = [(1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one"), (None, base), (9, "x" * 30_000 + " y"), (10, "of " * 9000), (11, base.upper()), (12, "é — ž"), (13, None), (14, "12 345 !!")]
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 else "en", None if i == 7 else f"s{(i or 0) % 2}", 0, 1, "c", 2, "z", 3, "t", 4, 5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda d: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[40:80] = v[40]  # a hot vector
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(0, [float(x) for x in v[0]], 1), (900, None, 1), (901, [0.0] * 8, 1), (902, [math.nan] * 8, 1), (None, [1.0] * 8, 1), (920, [1.0, None] * 4, 1), (940, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20, query_rows=7, candidate_rows=50).collect()}
    assert {q for q, _ in got} == set(range(0, 300, 20))
    for q in range(0, 300, 20):
        scores = neighbours.exact(np.repeat(v[q : q + 1].astype(float), 300, 0), v.astype(float))
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert [got[q, r] for r in range(1, 21)] == [(i, -s) for s, i in best]
    assert neighbours.search(df.limit(0), F.lit(True), 20).count() == 0
    assert neighbours.search(df.filter("vec_id < 3"), F.col("vec_id") == 0, 20).count() == 2


def test_neighbours_with_several_vectors_of_an_id_and_huge_components(spark):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((120, 6))
    v[5] *= 1e200
    v[6], v[7] = v[5] * 2, -v[5]
    ids = [i % 90 for i in range(120)]  # thirty ids have two vectors
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, candidate_rows=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80}
    for q, found in got.items():
        best = {}
        for a in (x for i, x in rows if i == q):
            for i, x in rows:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float(neighbours.exact(np.array([a]), np.array([x]))[0]))
        want = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:20]
        assert [(i, s) for _, i, s in sorted(found)] == want
    wide = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert neighbours.search(wide, F.col("vec_id") == 0, 20).count() == 20


def test_int8_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((50, 16)), rng.standard_normal((60, 16)) * 100
    kept = {(i, j) for x in neighbours.tile(a, b, 5) for i, j in zip(x[0].tolist(), x[1].tolist(), strict=True)}
    best = np.argsort(-(a @ b.T), axis=1)[:, :5]
    assert all((i, int(j)) in kept for i in range(50) for j in best[i])


def test_language_gradient_and_learning():
    net = language.Network.fresh(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    seqs, y = [b"abc", b"de"], np.array([0, 1])
    _, grad = net.gradient(seqs, y)
    for name in ("uf", "cb", "xf", "out", "emb"):
        w = net.weights[name]
        at = tuple(0 if name != "emb" or i else 97 for i in range(w.ndim))
        ends = []
        for step in (1e-3, -2e-3):
            w[at] += step
            ends.append(net.gradient(seqs, y)[0])
        w[at] += 1e-3
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[name][at]) < 2e-3
    net = language.Network.fresh(["a", "b"])
    losses = net.train([b"tion", b"sch", b"ing", b"ung"] * 10, np.array([0, 1, 0, 1] * 10), steps=60, batch=40)
    assert losses[-1] < 0.3 * losses[0]


def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op2_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.9 and found.score.between(0, 1).all()


def test_language_cases(odd, none):
    net = language.fit(odd, fold(F.col("doc_id"), 5) != 0, steps=5)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, net).collect()}
    assert all(got[i] == "und" for i in (4, 5, 6, 14)) and got[12] == "en"
    marked = odd.withColumn("_letter", F.lit("mine")).withColumn("lang_pred", F.lit("old"))
    assert language.predict(marked, net).columns == [c for c in marked.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    assert {r["_letter"] for r in language.predict(marked, net).collect()} == {"mine"}
    long = "é" * 30 + "漢" * 20 + "x"
    assert b"".join(language.pieces(long)) == long.encode() and all(len(p) <= language.LONGEST and p.decode() for p in language.pieces(long))
    assert language.fit(none, F.lit(True)) is None and language.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}


def test_token_records(spark, odd, none, tmp_path):
    tok = Tokenizer.from_file(TOKENIZER)
    path = f"file://{tmp_path}/rec"
    token_records.write(odd, path, TOKENIZER, 2, shard_bytes=20_000)
    rows = sorted(((r["doc_id"], r["h"], r["text"]) for r in odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    back = token_records.with_starts(token_records.read_records(spark, path, with_ids=True)).orderBy("start").collect()
    start = 0
    for (doc, _, text), r in zip(rows, back, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = token_records.fetch(spark, path, spark.createDataFrame([(7,), (9,), (99,)], "doc_id long"))
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 9]
    assert token_records.encode_table(none, TOKENIZER, 2).count() == 0


def test_token_records_with_any_tokenizer(spark, odd, tmp_path):
    """Words are encoded one by one only where that is proved to be right; other tokenizers, and the same one with other settings, get whole texts."""
    spec = open(TOKENIZER, encoding="utf-8").read()
    plain = json.loads(spec)
    plain["normalizer"] = None
    (tmp_path / "plain.json").write_text(json.dumps(plain))
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert [token_records.by_words(open(p, encoding="utf-8").read()) for p in (TOKENIZER, other, tmp_path / "plain.json")] == [True, False, False]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "Hello there, good people of the World.  Two  spaces"), (21, " leading, and\ttabs\n")], "doc_id long, text string")).filter("length(text) < 1000")
    for n, path in enumerate((other, tmp_path / "plain.json")):
        tok = Tokenizer.from_file(str(path))
        token_records.write(docs, f"file://{tmp_path}/{n}", str(path), 2)
        got = sorted((r["doc_id"] or 0, r["ids"]) for r in token_records.read_records(spark, f"file://{tmp_path}/{n}", with_ids=True).collect())
        assert got == sorted((r["doc_id"] or 0, [*tok.encode(r["text"], add_special_tokens=False).ids, 2]) for r in docs.collect())


def test_many_rows_of_one_id_are_spread(spark, tmp_path):
    docs = spark.range(400).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    token_records.write(docs, f"file://{tmp_path}/rec", TOKENIZER, 2, shard_bytes=800)
    index = token_records.with_starts(spark.read.parquet(f"file://{tmp_path}/rec/index"))
    for doc in ("is null", "= 7"):
        assert index.filter(f"doc_id {doc}").select("shard").distinct().count() > 2
    ends = 0
    for r in index.orderBy("start").collect():
        assert r["start"] == ends
        ends += r["n_tokens"]


def test_damaged_records_are_found():
    data = bytearray(token_records.frame(b"payload") + b"\n")
    assert bytes(token_records.read_frame(memoryview(data), 0)[0]) == b"payload"
    data[13] ^= 4
    with pytest.raises(token_records.Damaged):
        token_records.read_frame(memoryview(data), 0)


def test_distinct_words_are_taken_from_arrow_at_once():
    """Taking them one by one costs more than all else that is done to split a text."""
    text = pa.array([" ".join(f"w{i}x{j} É{j}" for j in range(200)) for i in range(200)] + [None, "", "  "])
    plain = sorted({w for t in text.to_pylist() for w in WORD.findall(t or "")})
    cost = lambda f: -time.process_time() + (f(), time.process_time())[1]
    least = lambda f: min(cost(f) for _ in range(5))
    assert least(lambda: common.words_of(text)) < least(pa.array(plain).to_pylist)
    starts, codes, found = common.words_of(text)
    assert sorted(w for w in found if w) == plain and [found[c] for c in codes[starts[3] : starts[4]]] == WORD.findall(text[3].as_py())


def test_hash_index_against_a_dictionary():
    rng, index, plain = np.random.default_rng(5), common.HashIndex(), {}
    assert index.find(np.zeros(2, np.uint64)).tolist() == [-1, -1]
    for _ in range(4):
        new = np.setdiff1d(rng.integers(0, 5000, 900, np.uint64), np.fromiter(plain, np.uint64, len(plain)))
        rng.shuffle(new)
        index.add(new)
        plain |= {h: len(plain) + i for i, h in enumerate(new.tolist())}
        asked = rng.integers(0, 6000, 2000, np.uint64)
        assert index.find(asked).tolist() == [plain.get(h, -1) for h in asked.tolist()]
    assert index.find(asked[:0]).tolist() == []


def test_word_encoder_equals_whole_texts():
    enc, tok, rng = token_records.WordEncoder(open(TOKENIZER, encoding="utf-8").read()), Tokenizer.from_file(TOKENIZER), random.Random(1)
    signs = "aAbBéÉeß.,;:!?'’s \t\n\x0b\x1c\x85  <|>endoftext0123456789%&*-́ŽžİΣσ漢字"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["foo<|endoftext|>bar <|STARTOFTEXT|> Don't. can't, A. b! c?? x.."]
    ids, starts = enc.encode(pa.array(texts))
    assert all(tok.encode(t, add_special_tokens=False).ids == ids[starts[i] : starts[i + 1]].tolist() for i, t in enumerate(texts))


def test_url_filters(spark):
    day = lambda d: f"2024-01-{d:02}"
    entries = spark.createDataFrame([("Bad.org", "add", day(5)), ("bad.org", "remove", day(10)), ("bad.org", "add", day(20)), ("sub.bad.org", "add", day(1)), ("x.org", "add", day(3)), ("x.org", "remove", day(3)), (None, "add", day(1)), ("y.org", "add", None)], "rule string, action string, listed_at string").withColumn("listed_at", F.to_date("listed_at"))
    urls = [("http://a.bad.org/x", 4, None), ("http://a.bad.org:80/x", 5, "bad.org"), ("https://u@BAD.org./", 9, "bad.org"), ("http://bad.org?q", 10, None), ("http://bad.org", 25, "bad.org"), ("http://sub.bad.org/", 6, "sub.bad.org"), ("http://notbad.org/", 6, None), ("http://x.org/", 4, None), (None, 6, None), ("nonsense", 6, None)]
    names = ("listed_at", "spans", "host", "rule", "blocked", "__host", "__salt", "__spans", "__salts", "n", "valid_from", "a.b")
    caps = spark.createDataFrame([(i, u, day(d), *names) for i, (u, d, _) in enumerate(urls)], "page_id int, url string, fetched_at string, " + ", ".join(f"`{c}` string" for c in names)).withColumn("fetched_at", F.to_date("fetched_at"))
    found = url_filters.evaluate(caps, entries)
    assert found.columns == [c for c in caps.columns if c not in ("host", "rule", "blocked")] + ["host", "blocked", "rule"]
    got = {r["page_id"]: r for r in found.collect()}
    assert {i: r["rule"] for i, r in got.items()} == {i: want for i, (_, _, want) in enumerate(urls)}
    assert all(r["blocked"] == (r["rule"] is not None) and r["__host"] == "__host" for r in got.values()) and got[0]["host"] == "a.bad.org" and got[8]["host"] is None
    assert url_filters.evaluate(caps, entries.limit(0)).filter("blocked").count() == 0
    assert url_filters.evaluate(caps.limit(0), entries).count() == 0


def test_url_filters_hot_and_missing_hosts(spark):
    """A host with most captures, and captures without a host, against a plain walk over the list."""
    rng, days = random.Random(4), lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d)
    history = [(rng.choice(["hot.org", "a.hot.org", "cold.net"]), rng.choice(["add", "remove"]), rng.randrange(60)) for _ in range(40)]
    rows = [(i, rng.choice(["http://a.hot.org/"] * 8 + ["http://cold.net", None, "no url", "http://other.com"]), rng.choice([None, *range(70)])) for i in range(3000)]
    entries = spark.createDataFrame(history, "rule string, action string, day int").select("rule", "action", days(F.col("day")).alias("listed_at"))
    caps = spark.createDataFrame(rows, "page_id int, url string, day int").withColumn("fetched_at", days(F.col("day")))
    last = {}
    for rule, action, day in history:
        last[rule, day] = max(action, last.get((rule, day), ""))

    def want(url, day):
        host = {"http://a.hot.org/": ("hot.org", "a.hot.org"), "http://cold.net": ("cold.net",)}.get(url, ())
        active = [r for r in host if day is not None and max(((d, a) for (rule, d), a in last.items() if rule == r and d <= day), default=(0, "remove"))[1] == "add"]
        return max(active, key=len, default=None)

    assert {r["page_id"]: r["rule"] for r in url_filters.evaluate(caps, entries).collect()} == {i: want(u, d) for i, u, d in rows}


def test_lm_against_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id > 3").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    seventh = fold(F.col("doc_id"), 7)
    got = lm.score(docs, seventh != 2, F.coalesce(seventh == 2, F.lit(False)), top_words=50).collect()
    texts = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == docs.count()
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert -math.inf < r["score"] < 0
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert lm.score(none, F.lit(True), F.lit(False)).count() == 0
    assert lm.score(odd.select("doc_id", "text"), F.lit(False), F.lit(True)).count() == odd.count()


def test_log_bloom_never_loses_a_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    counts = np.arange(len(keys)) % 90 + 1
    full = lm.joined([lm.filled(keys, lm.levels(counts), 10)])
    assert (full.levels(keys) >= lm.levels(counts)).all() and (full.levels(keys) == lm.levels(counts)).mean() > 0.95
    many = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (lm.unpacked(lm.packed(many)) == many).all() and lm.levels(many).tolist() == [0, 1, 8, 8, 9, 41]
    own = lm.trimmed(keys[keys >> np.uint64(59) == 3], 5)
    assert (lm.long(lm.short(own, 5), 3, 5) == own).all()


def test_lm_scores_against_brute_force(spark, odd, monkeypatch):
    """Scores from exact counts, quantised, with filters too wide to err: all pairs broadcast, few of them, none, and keys cut in two steps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    docs = Scratch(spark, "lm-test").save(docs.repartition(3), "docs")
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if i is not None and not held(i)]
    single, both = Counter(w for t in train for w in [*t, None]), Counter(p for t in train for p in zip([0, *t], [*t, None], strict=True))
    n, v, n_docs = sum(single.values()), len(single), len(train)
    near = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0

    def logp(w, after):
        own, context, pair = n_docs if after is None else near(single[after]), n_docs if w == 0 else near(single[w]), near(both[w, after])
        share = lm.MIX * context / (context + lm.TRUST)
        return math.log10(share * min(pair, context) / max(context, 1) + (1 - share) * min(1.0, (own + 1) / (n + v + 1)))

    want = sorted((i or 0, round(sum(logp(*p) for p in zip([0, *t], [*t, None], strict=True)), 6)) for i, t in rows)
    seventh = fold(F.col("doc_id"), 7)
    monkeypatch.setattr(lm, "RANGE_BYTES", 16 << 10)
    for max_bytes, top_words, fan in ((1 << 30, 1 << 30, 12), (20_000, 50, 12), (0, 0, 2)):
        monkeypatch.setattr(lm, "FAN_BITS", fan)
        got = lm.score(docs, seventh != 2, F.coalesce(seventh == 2, F.lit(False)), max_bytes=max_bytes, top_words=top_words, bits_per_key=64).collect()
        assert sorted((r["doc_id"] or 0, round(r["score"], 6)) for r in got) == want
        assert abs(sum(r["base_score"] for r in got) - sum(math.log10((single[w] + 1) / (n + v + 1)) for _, t in rows for w in [*t, None])) < 1e-4


def test_lm_keeps_rare_words_at_any_filter_size(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_BYTES", 16 << 10)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stats = lm.gather(docs, F.lit(True), Scratch(spark, "rare"))
    assert stats.bits > 3 and stats.pairs_by_level[1] > 0
    j, whole = lm.frequent_filter(stats)
    size = len(whole.data)
    least, few = lm.frequent_filter(stats, max_bytes=size // 3)
    assert not j and least and len(few.data) <= size // 3 + 64 * 8
    kept = [np.frombuffer(r["wk"], np.uint64) for r in stats.table.select("wk").collect()]
    assert sum(map(len, kept)) == len({w for r in docs.collect() for w in words(r["text"])})


def test_decontaminate(spark, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(3)
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    first = next(iter(items))
    text = items[first]
    changed = text[:40] + "zq" + text[45:]
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, f"before {changed.upper()}\n after"), (3, "nothing here at all"), (4, None), (5, text.replace(" ", "\n  "))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, first), (2, first), (5, first)} and got[1, first] == 0 == got[5, first]
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench, block_bytes=300).collect()} == {3, 4}
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.clean(odd, bench).count() == odd.count()


def test_short_items_match_whole_words(spark):
    docs = spark.createDataFrame([(1, "another thing"), (2, "go to THE end"), (3, "the"), (4, "breathe, (the) air"), (5, "x_the")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "air"), (3, "(")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(2, 1), (3, 1), (4, 1), (4, 2)]


def test_decontaminate_against_plain_edit_distance(spark):
    """Every unit of every item against whole texts by the table of edit distances, no pieces and no windows."""
    rng = random.Random(27)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    docs = [(r["doc_id"], r["text"][:700]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").limit(12).collect()]
    for n, (_, item) in enumerate(bench * 6):  # planted with more and more edits, around the limit
        chars = list(item)
        for _ in range(int(len(item) * 0.035 * (n % 5))):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice(["", "#", chars[at] + "#"])
        docs.append((1000 + n, f"some words before {''.join(chars)} and after"))
    want = set()
    for item, text in bench:
        for no, unit in enumerate(decontaminate.units(decontaminate.normal(text))):
            k = int(len(unit) * decontaminate.RATE)
            for doc, text_ in docs:
                t = np.array([ord(c) for c in decontaminate.normal(text_)])
                row = np.zeros(len(t) + 1, np.int64)
                for i, ch in enumerate(unit, 1):
                    step = np.concatenate(([i], np.minimum(row[:-1] + (t != ord(ch)), row[1:] + 1)))
                    row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
                if row.min() <= k:
                    want.add((doc, item, no, int(row.min())))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["unit"], r["distance"]) for r in got} == want and len(want) > 20


def test_myers_against_the_table():
    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, n))) for n in (9, 14))
        row = list(range(len(p) + 1))
        best = len(p)
        for ch in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        bits = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
        got = decontaminate.myers(bits, len(p), t, len(p) - 1)
        assert (got[0] if got else len(p)) == best


def test_mixing_starts_no_rdd_workers(spark):
    """A list of rows becomes an RDD that Python workers of another kind than those of Arrow batches read."""
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan


def test_encoding_holds_little_beside_its_text():
    """The most that a slice of texts takes, next to the known words."""
    assert token_records.ENCODE_BYTES <= 1 << 20
    text = pa.array([" ".join(f"w{i}x{j}" for j in range(100)) for i in range(9000)])
    batch = pa.record_batch([text], ["text"])
    parts = list(common.text_slices(iter([batch]), limit=token_records.ENCODE_BYTES))
    assert len(parts) > 5 and pa.concat_arrays([p.column(0) for p in parts]).equals(text)


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    sums = got.groupby("source", dropna=False).agg(target=("target", "max"), taken=("taken", "sum"), size=("size", "sum"), own=("source_size", "max"))
    assert (sums["size"] == sums["own"]).all() and ((sums["taken"] - sums["target"]).abs() <= 0.02 * sums["target"] + 60).all()
    assert (got["taken"] <= 3 * got["size"]).all() and abs(sums["target"].sum() - sums["size"].sum()) < 1e-6 * sums["size"].sum()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    whole = mixing.mix(odd, keep_rows=True).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == whole


def test_targets_and_knapsack():
    assert mixing.targets([("a", 10), ("b", 100), ("c", 890)]) == [30.0, 300.0, 670.0]
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0.0]
    rng = random.Random(2)
    for _ in range(100):
        lengths = sorted(rng.sample(range(1, 30), 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(x * n for x, n in zip(lengths, counts, strict=True)))
        sums = {0}
        for x, n in zip(lengths, counts, strict=True):
            sums = {s + x * m for s in sums for m in range(n + 1)}
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(took, counts, strict=True))
        assert abs(sum(x * t for x, t in zip(lengths, took, strict=True)) - budget) == min(abs(s - budget) for s in sums)


def test_knapsack_goes_past_the_budget_by_one_long_document():
    lengths = [600_001, 600_010, 600_100]
    took = mixing.fit(lengths, [1, 1, 1], 1_000_000)
    assert sum(took) == 2 and abs(sum(x * t for x, t in zip(lengths, took, strict=True)) - 1_000_000) < 201_000


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
                    changed = True
    return sets, root


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(8)
    docs = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in odd.collect()) if i is not None]
    base = [f"b{rng.randrange(900)}" for _ in range(120)]
    for i in range(100, 140):  # a chain of copies, each a little further off
        base = base[:]
        base[rng.randrange(120)] = f"n{i}"
        docs.append((i, " ".join(base)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (4, 5):
        sets, root = brute_components(dict(docs).items(), k, 80)
        got = near_dedup.near_duplicates(df, k, 80).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (root[r["doc_id"]], len(sets[r["doc_id"]]), root[r["doc_id"]] == r["doc_id"])
    stay = near_dedup.keep_one(odd)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 12, 13, 14]
    assert near_dedup.near_duplicates(none).count() == 0


def test_hyperminhash_estimate():
    rng = np.random.default_rng(3)
    common, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (800, 100, 100))
    x, y = np.sort(np.concatenate((common, a))), np.sort(np.concatenate((common, b)))
    regs = near_dedup.registers(np.array([0, len(x), len(x) + len(y)]), near_dedup.mix64(np.concatenate((x, y))))
    est = near_dedup.estimate((regs[0] == regs[1]).sum(), len(x), len(y))
    assert abs(est - 0.8) < 0.15 and near_dedup.collision_rate(900, 900) < 0.01


def test_estimate_loses_no_more_than_the_bands():
    least, n = near_dedup.least_estimate(0.8), near_dedup.REGISTERS
    lost = sum(math.comb(n, a) * 0.8**a * 0.2 ** (n - a) for a in range(n + 1) if a / n < least)
    assert lost < (1 - 0.8**near_dedup.ROWS) ** (n // near_dedup.ROWS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 90, 95: 90}


def test_passages(spark, odd, none):
    rng = random.Random(6)
    text = lambda n, p: [f"{p}{rng.randrange(10_000)}" for _ in range(n)]
    shared = text(70, "s")
    fuzzy = [*shared[:30], "changed", *shared[31:]]
    docs = [(1, text(90, "a") + shared + text(20, "a")), (2, shared + text(40, "b")), (3, text(33, "c") + fuzzy), (4, text(200, "d")), (5, text(10, "e") + shared[:20] + text(10, "e"))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.both_sides(substring_dedup.passages(df)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[2]["start"], got[2]["end"], got[2]["other_start"], got[2]["distance"]) == (0, 70, 90, 0)
    assert (got[3]["start"], got[3]["end"], got[3]["distance"]) == (33, 103, 1)
    assert substring_dedup.passages(none).count() == 0
    found = {r["doc_id"] for r in substring_dedup.both_sides(substring_dedup.passages(odd)).collect()}
    assert {1, 2, 3, 11} <= found and not found & {4, 5, 6, 7, 8, 12, 13, 14}


def test_exact_repeats_against_brute_force(spark):
    """Every word of a 50-word window that a later document repeats is in a reported passage: two sources, short sources, rounds of a line."""
    rng = random.Random(16)
    text = lambda n, p: [f"{p}{rng.randrange(10_000)}" for _ in range(n)]
    two, part, line, word = text(60, "t"), text(60, "p"), text(12, "l") * 12, ["of"] * 70
    docs = [
        (1, text(20, "a") + two[:30] + text(20, "a")), (2, text(25, "b") + two[30:] + text(20, "b")), (3, text(15, "c") + two + text(30, "c")), (4, text(35, "d") + two + text(10, "d")),
        (5, text(20, "e") + part[10:45] + text(20, "e")), (6, part + text(30, "f")), (7, text(30, "g") + part), (10, text(9, "h") + line + text(9, "h")), (11, text(14, "i") + line + text(5, "i")),
        (12, text(9, "j") + word + two[:10] + text(9, "j")), (13, text(14, "k") + word[:45] + two[:10] + text(5, "k")),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    missed, want = missed_windows(df)
    assert {i for i, x in want.items() if x} == {4, 7, 11, 13} and not missed


def missed_windows(df):
    """Word places in 50-word windows that an earlier document has too and that are in no reported passage, by document; and all such places."""
    seen, texts = {}, [(r["doc_id"], words(r["text"])) for r in df.collect()]
    for i, w in texts:
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    want = {i: set() for i, _ in texts}
    for places in seen.values():
        first = min(places)[0]
        for i, p in places:
            if i != first:
                want[i] |= set(range(p, p + 50))
    got = {i: set() for i, _ in texts}
    for r in substring_dedup.passages(df).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    return {i: sorted(x - got[i]) for i, x in want.items() if x - got[i]}, want


def test_every_repeated_window_of_the_documents_is_found(spark):
    missed, want = missed_windows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("text is not null"))
    assert not missed and sum(map(len, want.values())) > 1000


def test_fuzzy_passages_by_identity(spark):
    """Passages of 80 words with words replaced, missing or added at a rate, forty for each: how many are found."""
    rng, docs = random.Random(36), []
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    rates = (0.0, 0.05, 0.1, 0.15)
    for n in range(160):
        passage = text(80)
        changed = [y for x in passage for y in ([x] if rng.random() >= rates[n % 4] else rng.choice([[], text(1), text(1), [x, *text(1)]]))]
        docs += [(2 * n, " ".join(text(40) + passage + text(30))), (2 * n + 1, " ".join(text(25) + changed + text(50)))]
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(a == b + 1 for a, b in found)
    recall = [sum((2 * n + 1, 2 * n) in found for n in range(i, 160, 4)) / 40 for i in range(4)]
    assert recall[0] == 1 and recall[1] >= 0.95 and recall[2] >= 0.85 and recall[3] >= 0.5, recall


def test_passages_whose_seed_is_first_elsewhere(spark):
    """Pairs whose only common seeds are in a line that a first document has without the rest, and that all pairs have."""
    rng = random.Random(46)
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    line, docs, want = text(12), [], set()
    docs.append((0, text(30) + line + text(30)))
    for n in range(1, 21):
        left, right = text(24), text(24)
        change = lambda w: [x if i % 5 else "changed" for i, x in enumerate(w, 1 + n % 3)]
        docs += [(2 * n, text(20) + left + line + right + text(20)), (2 * n + 1, text(35) + change(left) + line + change(right) + text(35))]
        want.add((2 * n + 1, 2 * n))
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()}
    assert found == want


def test_rounds_of_a_short_line_are_one_passage(spark):
    """Texts that repeat two words many times share one passage, not one for each round; every repeated window is still found."""
    rng = random.Random(56)
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    docs = [(i, text(20) + ["is", "onhe."] * n + text(20)) for i, n in enumerate((90, 60, 90, 75, 60, 90))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert substring_dedup.passages(df).count() <= 30
    missed, want = missed_windows(df)
    assert not missed and sum(map(len, want.values())) > 500


def test_shuffle_files_of_the_last_table_go_when_scratch_is_freed(spark):
    """Nothing has to run after a table is written for the shuffle files of its query to be deleted."""
    scratch, blocks = Scratch(spark, "freed"), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_(\d+)_", blocks.getAllBlocks().mkString(" ")))
    before = held()
    scratch.save(spark.range(1000).repartition(3, "id"), "table")
    own = held() - before
    assert own
    scratch.drop("table")
    until = time.time() + 10
    while own & held() and time.time() < until:
        time.sleep(0.1)
    assert not own & held()


def test_words_of_both_sides_are_shuffled_once(spark):
    h, scratch = np.arange(64, dtype=np.uint64), Scratch(spark, "once")
    words_ = scratch.save(spark.createDataFrame([(i, 0, 64, bytearray(h.tobytes())) for i in (1, 2)], substring_dedup.WORDS), "words")
    names = "doc long, a long, b long, other long, oa long, ob long, ra long, rb long, ora long, orb long, key long, settled boolean"
    wide = scratch.save(spark.createDataFrame([(2, 20, 28, 1, 20, 28, 0, 64, 0, 64, 0, False)], names), "wide")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = substring_dedup.compared(wide, words_, 50, 0.8)
        row = df.first()
        assert (row["doc_id"], row["start"], row["end"], row["other_id"], row["distance"]) == (2, 0, 64, 1, 0)
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_worker_keeps_one_operators_object():
    spec = Path(TOKENIZER).read_text(encoding="utf-8")
    first = token_records.encoder(spec)
    assert token_records.encoder(spec) is first
    model = toxicity.Model({}, None, np.zeros(1), np.zeros(1))
    assert toxicity.extractor(model) is toxicity.extractor(model) and len(common._KEPT) == 1
    assert token_records.encoder(spec) is not first
    common.forget()
    assert not common._KEPT


def test_chain_prefers_order():
    found = substring_dedup.anchors(np.array([0, 10, 20, 40]), np.array([100, 110, 120, 5]))
    best = substring_dedup.chains(found)[0]
    assert (best[0][0], best[-1][1]) == (0, 28)


def test_toxicity_query(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert (held.predicted == held.toxic).mean() > 0.93 and got.score.between(0, 1).all()
    assert hit.sum() / (held.toxic == 1).sum() >= 0.6 and hit.sum() / max(1, (held.predicted == 1).sum()) >= 0.8  # recall and precision


def test_toxicity_cases(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (7, 0), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.clean(odd, model).columns == odd.columns
    marked = odd.withColumn("__toxicity", F.lit(5.0)).withColumn("fold", F.lit(9)).withColumn("f0", F.lit("x"))
    assert {(r["__toxicity"], r["toxicity"]) for r in toxicity.clean(marked, toxicity.fit(marked, labels, F.lit(True)), 1.1).collect()} == {(5.0, "t")}
    assert toxicity.fit(odd, labels.limit(0), F.lit(True)).score(np.zeros((2, 13))).tolist() == [0, 0]
    assert toxicity.score(none, model).count() == 0


def test_toxicity_keeps_the_class_ratio_of_all_labels(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(20)) + (" idiot" if i % 2 else ""), int(rng.random() < (0.25 if i % 2 else 0.02))) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    true = sum(t for i, _, t in rows if i % 2) / 800
    for most in (5000, 150):  # no class is capped; both are
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True), max_rows=most)
        got = toxicity.score(df.filter("doc_id % 2 = 1").select("doc_id", "text"), model).agg(F.avg("toxicity"), F.max("toxicity")).first()
        assert abs(got[0] - true) < 0.06 and got[1] < 0.5


def test_obfuscation_and_isotonic():
    x = toxicity.Extractor({})(pa.array(["you id1ot", "You are an i.d.i.o.t", "a fine day", None, "STUUUUPID"]))
    assert (x[[0, 1], toxicity.FEATURES.index("obfuscated")] > 0).all() and x[0, toxicity.FEATURES.index("near_second")] > 0
    assert not x[2:4, : toxicity.FEATURES.index("second")].any() and x[4, toxicity.FEATURES.index("obfuscated")] > 0
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def test_one_text_beyond_a_slice(spark, tmp_path):
    """A text above SLICE_BYTES, among others, through every operator on texts."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(4000)]
    long = " ".join(rng.choices(vocabulary, k=620_000)) + " you idiot"
    assert len(long) > 4 << 20
    part = " ".join(long.split(" ")[300_000:300_080])
    docs = spark.createDataFrame([(0, long, "en", "a"), (1, f"before {part} after", "en", "b"), (2, long, "en", "a"), (3, None, None, None), (5, "kurz und gut", "de", "b")], "doc_id long, text string, lang string, source string")
    tok = Tokenizer.from_file(TOKENIZER)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_records.encode_table(docs, TOKENIZER, 2).collect()}
    assert counts[0] == counts[2] == len(tok.encode(long, add_special_tokens=False).ids) + 1 and counts[3] == 1
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 5: 5}
    assert {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, part)], "item_id long, text string")).collect()} == {0, 1, 2}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes[0] == 620_002 and sizes[3] == 0
    scored = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") != 2, F.col("doc_id") == 2).collect()}
    assert scored[0]["n_tokens"] == 620_003 and abs(scored[0]["score"] - scored[2]["score"]) < 1e-6
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs, F.lit(True), steps=5)).collect()}[3] == "und"
    model = toxicity.fit(docs, spark.createDataFrame([(0, 1), (1, 0), (5, 0)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, model).count() == 5
    found = substring_dedup.passages(docs).collect()
    assert any(r["doc_id"] == 1 and r["other_id"] == 0 and r["end"] - r["start"] >= 80 for r in found) and any(r["doc_id"] == 2 and r["end"] - r["start"] > 100_000 for r in found)
