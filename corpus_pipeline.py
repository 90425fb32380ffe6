"""The corpus pipeline: documents to token records in five stages, each a written table.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of documents. Toxic documents go, one of each group of near
duplicates stays, documents that hold test items go, sources are mixed to their weights (a document taken twice is two rows), and what is
left is written as token records, whose index is the result. Before a stage the executors let go of what the one before it left in their heaps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, mixing, near_dedup, token_records, toxicity
from lodestrata.llm.common import Scratch, collect_garbage, fold, table

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins with collected heaps: peaks of memory are those of single stages, not sums of them."""

    @wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return run(spark, docs, sf_dir)

    return begun


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels are learned as op10 does."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.clean(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by shingles of five words at 0.8 the document with the smallest id stays."""
    return near_dedup.keep_one(docs, k=5, percent=80)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a unit of a test item within eight per cent of edits go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their weights' shares of all words: a document taken twice becomes two rows, one not taken goes, as does one without words."""
    return mixing.mixed(docs)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token records in ascending doc_id; the rows are their index: doc_id, start, n_tokens, ids_crc32 and the record's place."""
    return token_records.encode_table(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]

ORACLE_SQL = None  # no stage but the mix can be said in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, run_stage) in enumerate(STAGES):
        docs = scratch.save(run_stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
