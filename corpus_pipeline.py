"""Corpus pipeline: quality filter, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, and each is written as Parquet and read
back as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from statgate.llm import dedup, packing, quality, simhash
from statgate.llm.common import shared_dir, table
from statgate.llm.queries import QUALITY_THRESHOLD, SEQUENCE_TOKENS, SIMHASH_BITS, SIMHASH_SHINGLE, word_bpe


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the table labels, does not reject."""
    net = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, net, QUALITY_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id."""
    return dedup.keep_one(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id."""
    return simhash.keep_one(docs, SIMHASH_SHINGLE, SIMHASH_BITS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequence and place."""
    return packing.pack_documents(docs, word_bpe(), SEQUENCE_TOKENS)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Scores, fingerprints and packing are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
