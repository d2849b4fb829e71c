"""The corpus pipeline: documents through the operators of readprep.llm, each stage written and read again.

Stages take documents with any further columns. Null and empty texts, repeated rows and empty tables go through all of
them; what becomes of each is stated at the stages.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readprep.llm import common, minhash, mixing, packing, quality, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(own: Stage) -> Stage:
    """A stage that owns its tables in the shared folder: the next stage of this thread, whose input has then been written, deletes them."""

    @functools.wraps(own)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline-{threading.get_ident()}"
        common.clear(spark, owner)
        with common.owned(owner):
            return own(spark, docs, sf_dir)

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones of them, doesn't reject. Null and empty texts
    are scored as such; repeated rows stay or go together; an empty table gives no rows."""
    return quality.good_documents(docs, common.table(spark, sf_dir, "labels"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Texts without words, null ones too, are near nothing; rows that
    repeat doc_id and text stay once; an empty table gives no rows."""
    return minhash.distinct_documents(docs)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that an earlier document, or the text before, holds. No row goes: a text
    that is emptied stays as an empty one, a null one null; repeated rows are cut alike; an empty table gives no rows."""
    return suffix_dedup.deduplicated_documents(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin documents so that sources reach their target shares of the words. Texts without words, null ones
    too, stay once; repeated rows count as rows; an empty table gives no rows."""
    return mixing.mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 ids; a row is a piece with its ids. Null and empty texts are an end
    alone; repeated rows are documents of their own; an empty table gives no rows."""
    return packing.pack(docs, packing.vocabulary_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix),
    ("packing", pack),
]

ORACLE_SQL: str | None = None  # no stage's decisions can be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. A stage's output is deleted as soon as the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{common.shared_dir(spark)}/readprep/pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    common.clear(spark, f"pipeline-{threading.get_ident()}")
    return docs
