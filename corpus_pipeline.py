"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from commitloom.llm import decontaminate, factorization, lines, near_copies, packing
from commitloom.llm.common import prepare, store, table

VOCABULARY = "word_bpe_49k.json"
#: near-duplicate documents: shingles of five words, the least Jaccard similarity of their sets
SHINGLE, SIMILAR = 5, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 8: documents that the quality classifier does not reject."""
    return factorization.keep_good(docs, table(spark, folder, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 4: of each group of like lines, the first one stays."""
    prepare(spark)
    return lines.drop_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 10: of its classes' documents with like shingle sets, and of others that alike, one of each group stays."""
    prepare(spark)
    return near_copies.keep_one(docs, SHINGLE, SIMILAR)


def without_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 3: passages of benchmark items are cut."""
    return decontaminate.remove_items(docs, table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 5: pieces of the sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=2)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near-duplicate documents", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

#: The stages hold learned scores, hashes and a tokenizer; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Every stage in its order; between stages the documents are written and read again."""
    docs = table(spark, folder, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if place < len(STAGES) - 1:
            docs = store(docs)
    return docs
