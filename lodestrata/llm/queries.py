"""The queries of this subpackage and, where one exists, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lm, mixing, near_dedup, neighbours, substring_dedup, token_records, toxicity, url_filters
from .common import Scratch, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20"""
)
def op1_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, 20)


@query()
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    found = language.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query()
def op3_token_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_records.encode_table(docs, public_tokenizers.path(TOKENIZER), END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


# Fixed values of the query: a small dated list. The captures have no fetch time, so the day follows from the page's number.
LIST = (
    ("spam-farm.example.org", "add", 0), ("example.org", "add", 300), ("example.org", "remove", 320), ("tionsh.example.net", "add", 100), ("tionsh.example.net", "remove", 200),
    ("tionsh.example.net", "add", 250), ("blog.tionble.example.com", "add", 50), ("tionble.example.com", "add", 40), ("tionble.example.com", "remove", 60), ("m.tiontion.example.com", "add", 180),
    ("ththth.example.org", "add", 10), ("ththth.example.org", "add", 20), ("ththth.example.org", "remove", 30), ("thther.example.org", "add", 340), ("absent.example.com", "add", 1), ("ads-track.example.org", "add", 150),
)
FIRST_DAY = "2024-01-01"
LIST_SQL = ", ".join(f"('{r}', '{a}', DATE '{FIRST_DAY}' + {d})" for r, a, d in LIST)


@query(
    f"""WITH entries(rule, action, listed_at) AS (VALUES {LIST_SQL}),
    turns AS (SELECT *, lag(action) OVER (PARTITION BY rule ORDER BY listed_at) AS was FROM entries),
    spans AS (SELECT rule, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY rule ORDER BY listed_at) AS valid_to FROM turns WHERE was IS DISTINCT FROM action),
    captures AS (SELECT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id % 366 AS INTEGER) AS fetched_at,
      nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host FROM pages),
    hits AS (SELECT page_id, max(length(rule)) AS n, arg_max(rule, length(rule)) AS rule FROM captures c JOIN spans s ON s.action = 'add' AND (c.host = s.rule OR ends_with(c.host, '.' || s.rule))
      AND s.valid_from <= c.fetched_at AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to) GROUP BY page_id)
    SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, c.host, h.rule IS NOT NULL AS blocked, h.rule FROM captures c LEFT JOIN hits h USING (page_id)"""
)
def op4_url_filters(spark, sf_dir):
    first = F.lit(FIRST_DAY).cast("date")
    captures = table(spark, sf_dir, "pages", "page_id", "url").withColumn("fetched_at", F.date_add(first, (F.col("page_id") % 366).cast("int")))
    entries = spark.createDataFrame(LIST, "rule string, action string, day int").select("rule", "action", F.date_add(first, F.col("day")).alias("listed_at"))
    return url_filters.evaluate(captures, entries).withColumn("fetched_at", F.col("fetched_at").cast("string"))


@query()
def op5_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    seventh = fold(F.col("doc_id"), 7)
    return lm.score(docs, seventh != 2, F.coalesce(seventh == 2, F.lit(False)))


@query()
def op6_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query()
def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query(
    """WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM texts),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
    edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
    SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(r.m, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(r.m, t.doc_id)) AS kept
    FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1) r USING (doc_id)"""
)
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=80)


@query()
def op9_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    shared = Scratch(spark, "op9").save(substring_dedup.passages(docs), "passages")
    return substring_dedup.both_sides(shared)


@query()
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, model)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
