"""Queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bloom, countmin, hll
from ..operators import compaction, latest, merkle, scan, sequential, simhash
from ..schema import RESERVED_PREFIXES, EngineOptions, events_changelog, is_reserved
from ..sources import codec
from ..sources.registry import SketchRegistry
from ..sources.scratch import Scratch
from ..sources.store import KVStore, payload_of
from ..streaming import changelog as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOG = """log AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CAST(value AS VARCHAR) AS value,
  epoch_us(ts) AS ts, event_id AS seq, event_type = 'error' AS tombstone FROM events)"""
LATEST = LOG + """, latest AS (SELECT key, value, ts, seq, tombstone FROM log
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1),
live AS (SELECT key, value, ts, seq, tombstone FROM latest WHERE NOT tombstone AND coalesce(length(value), 0) > 0)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_changelog(table(spark, sf_dir, "events"))


# -- newest wins ----------------------------------------------------------------------------------------------------


@query(f"WITH {LATEST} SELECT * FROM latest")
def kv_latest(spark, sf_dir):
    return latest.latest_per_key(changelog(spark, sf_dir))


@query(f"WITH {LATEST} SELECT * FROM live")
def kv_live(spark, sf_dir):
    return latest.live(changelog(spark, sf_dir))


@query(f"WITH {LATEST} SELECT key, ts, seq FROM latest WHERE tombstone")
def kv_deleted_keys(spark, sf_dir):
    return latest.deleted_keys(changelog(spark, sf_dir))


@query(f"WITH {LATEST} SELECT * FROM live WHERE key = 'u000042'")
def kv_point_get(spark, sf_dir):
    return latest.point_get(changelog(spark, sf_dir), "u000042")


@query(
    f"""WITH {LOG}, runs AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(make_timestamp(ts) AS DATE)) AS BIGINT) AS generation FROM log),
    newest AS (SELECT key, value, generation, tombstone FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)
    SELECT key, value, generation FROM newest WHERE NOT tombstone AND key IN ('u000001', 'u000010', 'u000042', 'u000100')"""
)
def kv_get_with_source(spark, sf_dir):
    """Point reads that name the run the value came from."""
    wanted = runs(spark, sf_dir).filter(F.col("key").isin("u000001", "u000010", "u000042", "u000100"))
    return latest.live(wanted).select("key", "value", "generation")


@query(
    f"""WITH {LOG}, cut AS (SELECT CAST(floor((min(ts) + max(ts)) / 2.0) AS BIGINT) AS t FROM log), past AS (SELECT log.* FROM log, cut WHERE ts <= t),
    newest AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)
    SELECT key, value, ts, seq, tombstone FROM newest WHERE NOT tombstone AND coalesce(length(value), 0) > 0"""
)
def kv_as_of(spark, sf_dir):
    """The state half way through the log."""
    log = changelog(spark, sf_dir)
    t = log.agg(F.floor((F.min("ts") + F.max("ts")) / F.lit(2.0)).cast("bigint").alias("t")).first()["t"]
    return latest.as_of(log, t or 0)


@query(f"WITH {LOG} SELECT arg_max(key, (ts, seq)) AS key, max(ts) AS ts FROM log")
def kv_newest_key(spark, sf_dir):
    return latest.newest_key(changelog(spark, sf_dir))


# -- scans ----------------------------------------------------------------------------------------------------------


@query(f"WITH {LATEST} SELECT * FROM live WHERE starts_with(key, 'u0000')")
def kv_prefix_scan(spark, sf_dir):
    return scan.prefix_rows(changelog(spark, sf_dir), "u0000")


@query(f"WITH {LATEST} SELECT * FROM live WHERE key BETWEEN 'u000010' AND 'u000090'")
def kv_range_scan(spark, sf_dir):
    return scan.range_rows(changelog(spark, sf_dir), "u000010", "u000090")


@query(f"WITH {LATEST} SELECT * FROM live WHERE starts_with(key, 'u0000') ORDER BY key LIMIT 10 OFFSET 10")
def kv_prefix_page(spark, sf_dir):
    return scan.prefix_scan(changelog(spark, sf_dir), "u0000", 2, 10)


@query(f"WITH {LATEST} SELECT * FROM live WHERE key BETWEEN 'u000005' AND 'u000100' ORDER BY key LIMIT 15 OFFSET 30")
def kv_range_page(spark, sf_dir):
    return scan.range_scan(changelog(spark, sf_dir), "u000005", "u000100", 3, 15)


@query(f"WITH {LATEST} SELECT * FROM live ORDER BY key LIMIT 10 OFFSET 99999990")
def kv_page_out_of_range(spark, sf_dir):
    return scan.prefix_scan(changelog(spark, sf_dir), "", 10_000_000, 10)


@query(f"WITH {LATEST} SELECT max(key) AS key FROM live WHERE key <= 'u000055x'")
def kv_floor_key(spark, sf_dir):
    return scan.floor_key(changelog(spark, sf_dir), "u000055x")


PREFIXES = (*RESERVED_PREFIXES, "u", "sm_")


@query(
    f"""SELECT DISTINCT x || CAST(user_id AS VARCHAR) AS key, x IN ({', '.join(f"'{x}'" for x in RESERVED_PREFIXES)}) AS reserved FROM events,
    (VALUES {', '.join(f"('{x}')" for x in PREFIXES)}) AS t(x)"""
)
def reserved_prefix_filter(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    prefixes = F.explode(F.array(*[F.lit(x) for x in PREFIXES]))
    keys = users.select(F.col("user_id").cast("string").alias("u"), prefixes.alias("x")).select(F.concat("x", "u").alias("key"))
    return keys.select("key", is_reserved(F.col("key")).alias("reserved"))


@query(f"WITH {LATEST} SELECT key, value FROM live WHERE starts_with(key, 'u00001') ORDER BY key LIMIT 7")
def kv_prefix_iterate(spark, sf_dir):
    """Seven steps of a cursor over a prefix."""
    it = scan.prefix_iterate(changelog(spark, sf_dir), "u00001")
    rows = [(r["key"], r["value"]) for r, _ in zip(it, range(7), strict=False)]
    return spark.createDataFrame(rows, "key string, value string")


@query(f"WITH {LATEST} SELECT key, value FROM live WHERE key BETWEEN 'u000020' AND 'u000029' ORDER BY key LIMIT 5")
def kv_range_iterate(spark, sf_dir):
    """A cursor over a range that is stopped, begun again and read for five steps."""
    it = scan.range_iterate(changelog(spark, sf_dir), "u000020", "u000029")
    it.next()
    it.stop()
    it.reset()
    return spark.createDataFrame([(r["key"], r["value"]) for r, _ in zip(it, range(5), strict=False)], "key string, value string")


# -- runs and compaction ----------------------------------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut by day; a day is a run."""
    log = changelog(spark, sf_dir)
    return log.withColumn("generation", F.unix_date(F.timestamp_micros("ts").cast("date")).cast("bigint"))


RUNS = LOG + ", runs AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(make_timestamp(ts) AS DATE)) AS BIGINT) AS generation FROM log)"
MERGE = "SELECT key, value, ts, seq, tombstone FROM runs {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"


@query(f"WITH {RUNS}, merged AS ({MERGE.format(where='')}) SELECT * FROM merged WHERE NOT tombstone")
def kv_merge_runs(spark, sf_dir):
    """All runs into one at the bottom level: tombstones go."""
    return compaction.merge_runs([runs(spark, sf_dir)], bottom=True).drop("generation")


@query(f"WITH {RUNS}, few AS (SELECT DISTINCT generation AS g FROM runs ORDER BY g DESC LIMIT 3) {MERGE.format(where='WHERE generation IN (SELECT g FROM few)')}")
def kv_compact_level(spark, sf_dir):
    """The three newest runs into one while older runs stay: tombstones stay too."""
    r = runs(spark, sf_dir)
    few = r.select("generation").distinct().orderBy(F.desc("generation")).limit(3)
    return compaction.merge_runs([r.join(F.broadcast(few), "generation", "left_semi")], bottom=False).drop("generation")


@query(f"WITH {LATEST} SELECT count(*) AS n_keys, count(*) FILTER (WHERE tombstone) AS n_tombstones, count(*) FILTER (WHERE NOT tombstone) AS n_kept FROM latest")
def kv_tombstone_gc(spark, sf_dir):
    return latest.latest_per_key(changelog(spark, sf_dir)).agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("tombstone")).alias("n_tombstones"), F.count_if(~F.col("tombstone")).alias("n_kept")
    )


@query(f"WITH {RUNS} SELECT generation, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM runs GROUP BY 1")
def kv_table_bounds(spark, sf_dir):
    return compaction.run_bounds(runs(spark, sf_dir))


@query(
    f"""WITH {RUNS}, placed AS (SELECT DISTINCT generation, CAST(generation % 3 AS INTEGER) AS level FROM runs)
    SELECT level, generation, CAST(row_number() OVER (ORDER BY level, generation DESC) AS INTEGER) AS place FROM placed"""
)
def kv_read_order(spark, sf_dir):
    """The order in which a point read would visit the runs, dealt over three levels."""
    placed = runs(spark, sf_dir).select("generation").distinct().withColumn("level", (F.col("generation") % 3).cast("int"))
    return compaction.read_order(placed).select("level", "generation", "place")


# -- the store ----------------------------------------------------------------------------------------------------------

SLICES = 5


def filled_store(spark: SparkSession, sf_dir: str, options: EngineOptions) -> KVStore:
    """A store that took the log in batches, one stretch of time after the other."""
    store, log = KVStore(spark, Scratch(spark, "store").path, options), changelog(spark, sf_dir)
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    for i in range(SLICES if low is not None else 0):
        store.append(log.filter(F.floor((F.col("ts") - low) * SLICES / (high - low + 1)) == i))
    return store


@query(f"WITH {LATEST} SELECT key, value, ts, seq FROM live")
def store_size_tiered(spark, sf_dir):
    """The visible state of a store whose batches were merged two by two, level by level."""
    return filled_store(spark, sf_dir, EngineOptions(merge_threshold=2, max_levels=3)).live().select("key", "value", "ts", "seq")


@query(f"WITH {LATEST} SELECT key, value, ts, seq FROM live")
def store_leveled(spark, sf_dir):
    """The same with leveled compaction."""
    return filled_store(spark, sf_dir, EngineOptions(merge_threshold=2, max_levels=3, compaction="leveled")).live().select("key", "value", "ts", "seq")


@query(f"WITH {LATEST} SELECT key, value, ts, seq FROM live")
def stream_changelog(spark, sf_dir):
    """The log as a stream of files into a store."""
    scratch = Scratch(spark, "stream")
    log = scratch.save(changelog(spark, sf_dir).repartition(SLICES, "key"), "in")
    store = KVStore(spark, f"{scratch.path}/store", EngineOptions(merge_threshold=3))
    streams.append_stream(streams.read_stream(spark, f"{scratch.path}/in", log.schema, 2), store, f"{scratch.path}/checkpoint").awaitTermination()
    return store.live().select("key", "value", "ts", "seq")


@query(f"WITH {LOG} SELECT key, CASE WHEN tombstone THEN NULL ELSE value END AS value, ts, tombstone, row_number() OVER (ORDER BY ts, seq) - 1 AS place FROM log")
def wal_replay(spark, sf_dir):
    """The log packed into blocks, segment by segment, and read back: key, value, time and tombstone in the order they were written."""
    segments = Scratch(spark, "wal").save(codec.pack_log(changelog(spark, sf_dir)), "segments")
    back = codec.unpack_log(segments)
    sizes = back.groupBy(F.shiftright("seq", 32).alias("s")).agg(F.count("*").alias("n"))
    before = sizes.select("s", (F.sum("n").over(W.orderBy("s")) - F.col("n")).alias("before"))  # one row per segment
    return back.withColumn("s", F.shiftright("seq", 32)).join(before, "s").select("key", "value", "ts", "tombstone", (F.col("before") + F.col("seq").bitwiseAND(F.lit(0xFFFFFFFF))).alias("place"))


@query(
    f"""WITH {LATEST}, placed AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM latest)
    SELECT 0 AS level, idx FROM placed WHERE ends_with(key, '7')"""
)
def store_validate(spark, sf_dir):
    """The leaves of a run whose stored values were changed, for keys that end in 7, after its tree was saved."""
    scratch = Scratch(spark, "validate")
    store = KVStore(spark, f"{scratch.path}/store")
    g = store.append(latest.latest_per_key(changelog(spark, sf_dir)))
    store.save_merkle(g)
    run = store.log().drop("level", "generation")
    damaged = scratch.save(run.withColumn("value", F.when(F.endswith(F.col("key"), F.lit("7")), F.concat(F.coalesce("value", F.lit("")), F.lit("!"))).otherwise(F.col("value"))), "damaged")
    now = merkle.build(merkle.leaves(damaged, payload_of(damaged)))
    stored = spark.read.parquet(f"{store.base}/merkle/generation={g}")
    return merkle.diff(stored, now).select("level", "idx")


# -- sketches ---------------------------------------------------------------------------------------------------------

H64 = "(('0x' || substr(md5(encode(CAST({x} AS VARCHAR)) || {seed}), 1, 16))::UBIGINT)"


def seed_sql(seed: int) -> str:
    return "'" + "".join(f"\\x{b:02x}" for b in seed.to_bytes(4, "big")) + "'::BLOB"


def h64(x: str, seed: int) -> str:
    return H64.format(x=x, seed=seed_sql(seed))


BLOOM_M, BLOOM_K = bloom.parameters(15_000, 0.01)
BITS = ", ".join(f"CAST({h64('x', bloom.SEED_BASE + i)} % {BLOOM_M} AS BIGINT)" for i in range(BLOOM_K))
BLOOM = f"items AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS x FROM orders WHERE o_custkey IS NOT NULL), bits AS (SELECT DISTINCT unnest([{BITS}]) AS bit FROM items)"


def customers_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(table(spark, sf_dir, "orders"), "o_custkey", BLOOM_M, BLOOM_K)


@query(f"WITH {BLOOM} SELECT bit FROM bits")
def bloom_bits(spark, sf_dir):
    return customers_filter(spark, sf_dir)


@query(
    f"""WITH {BLOOM}, probes AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS x FROM customer), each_bit AS (SELECT x, unnest(list_distinct([{BITS}])) AS bit FROM probes)
    SELECT x, count(*) = count(bits.bit) AS maybe FROM each_bit LEFT JOIN bits USING (bit) GROUP BY x"""
)
def bloom_membership(spark, sf_dir):
    return bloom.membership(table(spark, sf_dir, "customer"), "c_custkey", customers_filter(spark, sf_dir), BLOOM_M, BLOOM_K)


@query(f"WITH {BLOOM} SELECT CAST(round(-{BLOOM_M} / {BLOOM_K}.0 * ln(1 - count(*) / {BLOOM_M}.0)) AS BIGINT) AS estimate FROM bits")
def bloom_estimated_cardinality(spark, sf_dir):
    return bloom.estimated_cardinality(customers_filter(spark, sf_dir), BLOOM_M, BLOOM_K)


CMS_M, CMS_K = countmin.parameters(0.001, 0.01)
CMS_ROWS = "\n UNION ALL ".join(f"SELECT {i} AS row, CAST({h64('x', countmin.SEED_BASE + i)} % {CMS_M} AS BIGINT) AS bucket, x, n FROM items" for i in range(CMS_K))
CMS = f"items AS (SELECT CAST(user_id AS VARCHAR) AS x, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1), cells AS ({CMS_ROWS})"


@query(f"WITH {CMS} SELECT row, bucket, CAST(sum(n) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2")
def cms_table(spark, sf_dir):
    return countmin.build(table(spark, sf_dir, "events"), "user_id", CMS_M, CMS_K)


@query(
    f"""WITH {CMS}, sketch AS (SELECT row, bucket, CAST(sum(n) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2)
    SELECT x, min(cnt) AS estimate FROM cells JOIN sketch USING (row, bucket) GROUP BY x"""
)
def cms_point_estimate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return countmin.estimate(events, "user_id", countmin.build(events, "user_id", CMS_M, CMS_K), CMS_M, CMS_K)


HLL_P = 10
FNV_SQL = """items AS (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) AS x FROM events),
hashed AS (SELECT x, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(x) + 1), lambda i: CAST(ascii(substr(x, i, 1)) AS HUGEINT))),
  lambda a, b: ((CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511627776) % 18446744073709551616 + CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 435) % 18446744073709551616) AS h FROM items),
regs AS (SELECT CAST(h // 18014398509481984 AS BIGINT) AS bucket, CAST(max(CASE WHEN h = 0 THEN 64 ELSE bit_count(xor(CAST(h AS UBIGINT), CAST(h - 1 AS UBIGINT))) - 1 END) AS INTEGER) AS rank FROM hashed GROUP BY 1)"""


def user_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("x"))
    return hll.registers(users, "x", HLL_P)


@query(f"WITH {FNV_SQL} SELECT bucket, rank FROM regs")
def hll_registers_ref(spark, sf_dir):
    return user_registers(spark, sf_dir)


@query(
    f"""WITH {FNV_SQL}, s AS (SELECT sum(power(2.0, -rank)) + (1024 - count(*)) AS total, greatest(1024 - count(*) FILTER (WHERE rank > 0), 0) AS empty FROM regs),
    r AS (SELECT (0.7213 / (1 + 1.079 / 1024)) * 1024 * 1024 / total AS raw, empty FROM s)
    SELECT round(CASE WHEN raw <= 2560 AND empty > 0 THEN 1024 * ln(1024 / empty) WHEN raw > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - raw / 4294967296.0) ELSE raw END, 6) AS estimate FROM r"""
)
def hll_estimate_ref(spark, sf_dir):
    return hll.estimate(user_registers(spark, sf_dir), HLL_P).select(F.round("estimate", 6).alias("estimate"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, true AS within FROM lineitem GROUP BY 1")
def hll_production(spark, sf_dir):
    """The built-in sketch, which another engine does not reproduce bit by bit: whether its estimate lies within 5 %, some three standard errors, of the exact count."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n"))
    both = hll.production(lines, "l_orderkey", ["l_returnflag"]).join(exact, "l_returnflag")
    return both.select("l_returnflag", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


@query(
    f"""WITH items AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS x, o_orderpriority AS part FROM orders WHERE o_custkey IS NOT NULL),
    bits AS (SELECT DISTINCT part, unnest([{BITS}]) AS bit FROM items), each_one AS (SELECT part, count(*) AS n FROM bits GROUP BY 1)
    SELECT CAST(sum(CAST(round(-{BLOOM_M} / {BLOOM_K}.0 * ln(1 - n / {BLOOM_M}.0)) AS BIGINT)) AS BIGINT) AS expected FROM each_one"""
)
def bloom_merge_expected(spark, sf_dir):
    """What a filter over five filters' union must expect, one filter for each priority."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey is not null")
    items = orders.select(F.col("o_custkey").cast("string").alias("x"), F.col("o_orderpriority").alias("part")).distinct()
    bits = items.select("part", F.explode(bloom.bits_of(F.col("x"), BLOOM_M, BLOOM_K)).alias("bit")).distinct()
    return bloom.expected_elements(bits, "part", BLOOM_M, BLOOM_K)


@query(
    f"""WITH {CMS}, sketch AS (SELECT row, bucket, CAST(sum(n) AS BIGINT) AS cnt FROM cells GROUP BY 1, 2), {FNV_SQL.replace('items', 'users').replace("'user' || ", "'' || ")},
    s AS (SELECT sum(power(2.0, -rank)) + (1024 - count(*)) AS total, greatest(1024 - count(*) FILTER (WHERE rank > 0), 0) AS empty FROM regs),
    r AS (SELECT (0.7213 / (1 + 1.079 / 1024)) * 1024 * 1024 / total AS raw, empty FROM s)
    SELECT true AS has, (SELECT min(cnt) FROM cells JOIN sketch USING (row, bucket) WHERE x = (SELECT CAST(min(user_id) AS VARCHAR) FROM events)) AS frequency,
      (SELECT round(CASE WHEN raw <= 2560 AND empty > 0 THEN 1024 * ln(1024 / empty) ELSE raw END, 6) FROM r) AS cardinality, 0 AS distance, true AS gone"""
)
def sketch_registry(spark, sf_dir):
    """Named sketches in a store: made, fed from the events, read back, asked and deleted."""
    reg, events = SketchRegistry(KVStore(spark, Scratch(spark, "registry").path, EngineOptions(run_rows=100))), table(spark, sf_dir, "events")
    reg.create_bloom("users", 1000, 0.01)
    reg.create_countmin("users", 0.001, 0.01)
    reg.create_hll("users", HLL_P)
    for kind in ("bloom", "countmin", "hll"):
        reg.add(kind, "users", events, "user_id")
    for name in ("a", "b"):
        reg.create_simhash(name, "the same words twice")
    one = str(events.agg(F.min("user_id")).first()[0])
    has, frequency, cardinality, distance = reg.contains("users", one), reg.frequency("users", one), round(reg.cardinality("users"), 6), reg.distance("a", "b")
    reg.delete("bloom", "users")
    gone = reg.store.get(RESERVED_PREFIXES[0] + "users") is None
    return spark.createDataFrame([(has, frequency, cardinality, distance, gone)], "has boolean, frequency long, cardinality double, distance int, gone boolean")


# -- documents --------------------------------------------------------------------------------------------------------

TOKENS = """each AS (SELECT doc_id, trim(unnest(string_split(text, ' ')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS token FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, token, count(*) AS n FROM each WHERE token <> '' GROUP BY 1, 2)"""
SUMS = ", ".join(f"sum(CASE WHEN (h{i // 64} >> {63 - i % 64}) & 1 = 1 THEN n ELSE -n END) AS s{i}" for i in range(128))
BYTES = " || ".join("printf('%02x', CAST(" + " + ".join(f"CASE WHEN s{8 * j + b} > 0 THEN {1 << b} ELSE 0 END" for b in range(8)) + " AS INTEGER))" for j in range(16))
PRINTS = f"""{TOKENS}, halves AS (SELECT doc_id, n, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS h0, ('0x' || substr(md5(token), 17, 16))::UBIGINT AS h1 FROM counted),
sums AS (SELECT doc_id, {SUMS} FROM halves GROUP BY doc_id), prints AS (SELECT doc_id, {BYTES} AS fingerprint FROM sums)"""
DISTANCE = " + ".join(f"bit_count(xor(('0x' || substr(a.fingerprint, {at}, 16))::UBIGINT, ('0x' || substr(b.fingerprint, {at}, 16))::UBIGINT))" for at in (1, 17))


@query(f"WITH {TOKENS} SELECT doc_id, token, n FROM counted")
def token_counts(spark, sf_dir):
    return simhash.token_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {PRINTS} SELECT doc_id, fingerprint FROM prints")
def simhash_fingerprint(spark, sf_dir):
    return simhash.fingerprints(table(spark, sf_dir, "documents"))


@query(f"WITH {PRINTS} SELECT b.doc_id, CAST({DISTANCE} AS INTEGER) AS distance FROM prints a, prints b WHERE a.doc_id = (SELECT min(doc_id) FROM prints)")
def simhash_hamming(spark, sf_dir):
    """Distance of every document from the first one."""
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"))
    first = prints.agg(F.min_by("fingerprint", "doc_id").alias("first"))
    return prints.crossJoin(F.broadcast(first)).select("doc_id", simhash.hamming(F.col("fingerprint"), F.col("first")).alias("distance"))  # one row


@query(
    f"""WITH {PRINTS} SELECT doc_id, lpad(bin(('0x' || substr(fingerprint, 1, 16))::UBIGINT), 64, '0') || lpad(bin(('0x' || substr(fingerprint, 17, 16))::UBIGINT), 64, '0') AS bits FROM prints"""
)
def simhash_bits(spark, sf_dir):
    return simhash.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", simhash.bit_string(F.col("fingerprint")).alias("bits"))


@query(
    f"""WITH {PRINTS}, reps AS (SELECT fingerprint, min(doc_id) AS rep FROM prints GROUP BY 1), met AS (SELECT a.rep AS id_a, b.rep AS id_b, CAST({DISTANCE} AS INTEGER) AS distance
    FROM reps a JOIN reps b ON a.rep < b.rep) SELECT id_a, id_b, distance FROM met WHERE distance <= 8"""
)
def simhash_near_dups(spark, sf_dir):
    """Pairs of distinct fingerprints within 8 bits, each named by its smallest document."""
    return simhash.near_pairs(simhash.fingerprints(table(spark, sf_dir, "documents")), 8)


# -- integrity --------------------------------------------------------------------------------------------------------


def run_leaves(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    run = latest.latest_per_key(changelog(spark, sf_dir))
    payload = F.encode(F.concat_ws("|", "key", F.col("ts").cast("string"), F.col("seq").cast("string"), F.when(F.col("tombstone"), "1").otherwise("0")), "utf-8")
    return merkle.leaves(run, payload, merkle.md5_leaf)


MD5_LEAVES = f"""{LATEST}, leaf AS (SELECT 0 AS level, row_number() OVER (ORDER BY key) - 1 AS idx,
md5(key || '|' || CAST(ts AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END) AS hash FROM latest)"""
DEPTH = 24
MD5_LEVELS = MD5_LEAVES + ", l0 AS (SELECT idx, hash FROM leaf)" + "".join(
    f", l{i} AS (SELECT idx // 2 AS idx, CASE WHEN (SELECT count(*) FROM l{i - 1}) = 1 THEN max(hash) ELSE md5(max(hash) FILTER (WHERE idx % 2 = 0) || coalesce(max(hash) FILTER (WHERE idx % 2 = 1), '')) END AS hash FROM l{i - 1} GROUP BY 1)"
    for i in range(1, DEPTH)
)


@query(f"WITH {MD5_LEAVES} SELECT level, idx, hash FROM leaf")
def merkle_leaves_md5(spark, sf_dir):
    return run_leaves(spark, sf_dir)


@query(f"WITH {MD5_LEVELS} SELECT hash AS root FROM l{DEPTH - 1}")
def merkle_root_md5(spark, sf_dir):
    return merkle.root(merkle.build(run_leaves(spark, sf_dir), merkle.md5_parent)).select("root")


CRC_STEP = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"
CRC_BITS = ", ".join(f"b{i} AS (SELECT i, {CRC_STEP.format(c='c')} AS c FROM b{i - 1})" for i in range(1, 9))


def crc_sql(data: str) -> str:
    """crc32 of a list of bytes, by the table ``crc_table``, made by rule."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(a // 256, crc_table[xor(a, b) % 256 + 1])), 4294967295)"


def le_sql(x: str) -> str:
    return f"[({x}) % 256, ({x}) // 256 % 256, ({x}) // 65536 % 256, ({x}) // 16777216]"


CRC_DEPTH = 14
CRC_LEVELS = ", ".join(
    f"""p{i} AS (SELECT idx // 2 AS idx, max(hash) FILTER (WHERE idx % 2 = 0) AS l, coalesce(max(hash) FILTER (WHERE idx % 2 = 1), 0) AS r FROM l{i - 1} WHERE (SELECT count(*) FROM l{i - 1}) > 1 GROUP BY 1),
    l{i} AS (SELECT idx, {crc_sql(f"list_concat({le_sql('l')}, {le_sql('r')})")} AS hash FROM p{i}, crc)"""
    for i in range(1, CRC_DEPTH)
)


@query(
    f"""WITH {LATEST}, b0 AS (SELECT i, i AS c FROM range(256) t(i)), {CRC_BITS}, crc AS (SELECT list(c ORDER BY i) AS crc_table FROM b8),
    raw AS (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key || coalesce('|' || value, '') AS payload FROM latest),
    l0 AS (SELECT idx, {crc_sql("list_transform(range(1, length(payload) + 1), lambda j: CAST(ascii(substr(payload, CAST(j AS BIGINT), 1)) AS BIGINT))")} AS hash FROM raw, crc), {CRC_LEVELS}
    """
    + " UNION ALL ".join(f"SELECT {i} AS level, idx, hash FROM l{i}" for i in range(CRC_DEPTH))
)
def merkle_tree_crc(spark, sf_dir):
    """All nodes of a tree, written as bytes and read back."""
    run = latest.latest_per_key(changelog(spark, sf_dir))
    tree = merkle.build(merkle.leaves(run, F.encode(F.concat_ws("|", "key", "value"), "utf-8")))
    return merkle.from_bytes(spark, merkle.to_bytes(tree))


@query(f"WITH {LATEST}, levels AS (SELECT count(*) AS n, CAST(ceil(log2(count(*))) AS INTEGER) AS top FROM latest), places AS (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, ends_with(key, '7') AS hit FROM latest) SELECT DISTINCT CAST(level AS INTEGER) AS level, idx // CAST(power(2, level) AS BIGINT) AS idx FROM places, levels, range(24) t(level) WHERE hit AND level <= top")
def merkle_validate_nodes(spark, sf_dir):
    """Every node, of any level, that differs once the values of keys that end in 7 are changed."""
    run = latest.latest_per_key(changelog(spark, sf_dir))
    changed = run.withColumn("value", F.when(F.endswith(F.col("key"), F.lit("7")), F.concat(F.coalesce("value", F.lit("")), F.lit("!"))).otherwise(F.col("value")))
    before, after = (merkle.build(merkle.leaves(r, payload_of(r))) for r in (run, changed))
    return merkle.diff(before, after, None).select("level", "idx")


MD5_PAIR = ", ".join(
    f"{t} AS (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, md5(key || '|' || {v}) AS hash FROM latest)" for t, v in (("stored", "value"), ("now", "CASE WHEN tombstone THEN '' ELSE value END"))
)


@query(f"WITH {LATEST}, {MD5_PAIR} SELECT 0 AS level, idx, stored.hash AS stored_hash, now.hash AS current_hash FROM stored FULL JOIN now USING (idx) WHERE stored.hash IS DISTINCT FROM now.hash")
def merkle_diff(spark, sf_dir):
    """Leaves that change when the values under tombstones are wiped."""
    run = latest.latest_per_key(changelog(spark, sf_dir))
    wiped = F.when(F.col("tombstone"), "").otherwise(F.col("value"))
    before = merkle.leaves(run, F.encode(F.concat_ws("|", "key", "value"), "utf-8"), merkle.md5_leaf)
    after = merkle.leaves(run, F.encode(F.concat(F.col("key"), F.lit("|"), wiped), "utf-8"), merkle.md5_leaf)
    return merkle.diff(before, after)


# -- sequential state ---------------------------------------------------------------------------------------------------

BUCKET_CAPACITY, BUCKET_RESET_MS = 3, 86_400_000


@query(
    f"""WITH RECURSIVE req AS (SELECT user_id, event_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    walk AS (SELECT user_id, event_id, i, ts_us AS since, {BUCKET_CAPACITY} - 1 AS tokens, true AS allowed FROM req WHERE i = 1
    UNION ALL SELECT r.user_id, r.event_id, r.i, CASE WHEN r.ts_us - w.since >= {BUCKET_RESET_MS}000 THEN r.ts_us ELSE w.since END,
      CASE WHEN r.ts_us - w.since >= {BUCKET_RESET_MS}000 THEN {BUCKET_CAPACITY} - 1 ELSE greatest(w.tokens - 1, 0) END,
      r.ts_us - w.since >= {BUCKET_RESET_MS}000 OR w.tokens >= 1 FROM walk w JOIN req r ON r.user_id = w.user_id AND r.i = w.i + 1)
    SELECT user_id, event_id, allowed, CAST(tokens AS INTEGER) AS tokens_left FROM walk"""
)
def token_bucket_decisions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    decided = sequential.token_bucket(events, BUCKET_CAPACITY, BUCKET_RESET_MS, "user_id", "ts_us", ["ts_us", "event_id"])
    return decided.select("user_id", "event_id", "allowed", "tokens_left")


@query(
    """WITH acc AS (SELECT user_id % 8 AS cache, user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events),
    prev AS (SELECT *, lag(i) OVER (PARTITION BY cache, key ORDER BY i) AS p FROM acc),
    seen AS (SELECT a.cache, a.i, count(DISTINCT b.key) AS others FROM prev a JOIN prev b ON b.cache = a.cache AND b.i > a.p AND b.i < a.i GROUP BY 1, 2)
    SELECT prev.cache, prev.key, prev.seq, prev.p IS NOT NULL AND coalesce(others, 0) < 5 AS hit FROM prev LEFT JOIN seen ON seen.cache = prev.cache AND seen.i = prev.i"""
)
def lru_hits(spark, sf_dir):
    """Eight caches of 5 keys, fed by the events in order."""
    acc = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("cache"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    return sequential.lru_simulation(acc, 5, "cache", "key", ["seq"]).select("cache", "key", "seq", "hit")


@query(
    """WITH acc AS (SELECT user_id % 8 AS cache, user_id AS key, event_id AS seq, event_type = 'error' AS gone, event_id AS i FROM events)
    SELECT cache, key, seq, coalesce(max(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY cache, key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM acc"""
)
def lru_remove(spark, sf_dir):
    """Caches large enough for all of their keys: puts, and removals by errors, after which a key is known as absent."""
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    acc = events.select((F.col("user_id") % 8).alias("cache"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"))
    return sequential.lru_simulation(acc, 1 << 20, "cache", "key", ["seq"], "op").select("cache", "key", "seq", "hit")
