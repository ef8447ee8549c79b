"""A pipeline over ``documents``; each stage's result is written as Parquet and read again for the next.

Quality rules drop what they reject, near-duplicate detection keeps one document of each class, decontamination drops
documents that hold a test item, the secret scan replaces reported spans, and BPE encodes what is
left and decodes it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rookery.llm import bpe_trie, decontam, probminhash, quality_rules, secret_scan
from rookery.llm._shared import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_trie.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decode=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scans", redact),
    ("bpe_encoding", encode),
]

#: No SQL can express the learned and hashed stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
