"""The pipeline's stages, each on what the one before it kept, against what is planted and what plain code finds."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, words
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import decontaminate, mixing
from lodestrata.llm.common import Scratch

SF = "/root/testdata/sf0.001"
COPY, NEAR, LEAK = 900_001, 900_002, 900_003


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000 or text is null")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = docs.filter("length(text) > 900").orderBy("doc_id")
    first = next(r for r in clean.collect() if labels.get(r["doc_id"]) != 1)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [(COPY, first["text"]), (NEAR, first["text"] + " and a tail"), (LEAK, f"quite another beginning {item} and an end")]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], docs.schema)
    scratch, out = Scratch(spark, "stages"), []
    docs = scratch.save(docs.unionByName(more), "docs")
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF), name)
        assert name == "token_records" or after.columns == docs.columns
        out.append((docs.collect(), after.collect()))
        docs = after
    return first["doc_id"], out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_records"]


def test_stages_begin_with_collected_heaps(spark):
    """Executors are threads of this JVM here."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collections = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = collections()
    corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert collections() > before
    assert all(hasattr(run, "__wrapped__") for _, run in corpus_pipeline.STAGES)


def test_toxic_documents_go(spark):
    """On the larger table, whose labels are enough to learn from."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ids(docs.select("doc_id").collect()), ids(corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect())
    bad, good = ([i for i in before if labels.get(i) == t] for t in (1, 0))
    assert not after - before and sum(i not in after for i in bad) >= 0.6 * len(bad) and sum(i in after for i in good) >= 0.95 * len(good)


def test_one_of_each_near_duplicate_group_stays(stages):
    first, out = stages
    before, after = out[1]
    _, root = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == Counter(i for i in ids(before) if root[i] == i)
    assert {COPY, NEAR}.isdisjoint(ids(after)) and first in ids(after)


def test_documents_with_test_items_go(spark, stages):
    _, out = stages
    before, after = out[2]
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert LEAK in ids(before) and LEAK not in ids(after)
    assert ids(after) == Counter(r["doc_id"] for r in before if not (r["text"] and matcher.match(decontaminate.normal(r["text"]))))


def test_sources_come_near_their_targets(stages):
    _, out = stages
    before, after = out[3]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    sums, taken = Counter(), Counter()
    for r in before:
        sums[r["source"]] += size[r["doc_id"]]
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    for s, target in zip(order, mixing.targets([(s, sums[s]) for s in order]), strict=True):
        assert abs(taken[s] - target) <= 60 + 0.02 * target
    assert max(ids(after).values()) <= 3


def test_records_hold_the_ids_of_whole_texts(stages):
    _, out = stages
    before, after = out[4]
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in after) == Counter((r["doc_id"], crc(r["text"])) for r in before)
    ends = 0
    for r in sorted(after, key=lambda r: r["start"]):
        assert r["start"] == ends
        ends += r["n_tokens"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.agg(F.sum("n_tokens")).first()[0] > 1000
