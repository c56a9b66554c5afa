"""The training-data pipeline: five stages, each one of the subpackage's operators.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``. The stages' decisions cannot all be put into SQL (trees,
suffix order, tokenizer), so there is no ``ORACLE_SQL``; tests hold the
stages against brute-force versions.

Stages accept any columns beside ``doc_id``, ``text``, ``lang`` and ``source``, null or empty
texts and empty tables; the operators' docstrings define the results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import jaccard_tree, mixing, packing, quality, suffix_dedup
from touchline.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect stays."""
    return jaccard_tree.keep_one(docs)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a string of 200 bytes occurring elsewhere covers go; ``n_chars`` is counted anew."""
    return suffix_dedup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sources' budgets take, once for each epoch that takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with token ids, placed in sequences."""
    return packing.packed_sequences(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
