"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.llm import (
    alignment,
    decontaminate,
    factorization,
    fingerprints,
    hard_negatives,
    interpolation,
    license_scan,
    lines,
    packing,
    simhash_trees,
    substrings,
    token_counts,
    token_files,
)
from commitloom.llm.oracles import ORACLES
from commitloom.llm.common import new_folder, table

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY, BYTE_LEVEL, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: tokens of a text that operator 11 reports as too long beyond
COUNT_LIMIT = 4096


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), new_folder(spark)
    token_files.write_tokens(docs, path, public_tokenizers.path(VOCABULARY), end_id=1)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contamination(docs, items)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=2)


def op6_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score_texts(table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, folder, "documents"))


def op8_factorization(spark: SparkSession, folder: str) -> DataFrame:
    return factorization.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(substrings.repeats(table(spark, folder, "documents")))


def op10_simhash_trees(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_trees.near_duplicates(table(spark, folder, "documents"))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(PIECES), COUNT_LIMIT)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, "embedding", shifted, F.col("vec_id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_interpolation": op6_interpolation,
    "op7_fingerprints": op7_fingerprints,
    "op8_factorization": op8_factorization,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_trees": op10_simhash_trees,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}
