"""A corpus from raw documents to training shards: each stage works on all that the one before it kept.

quality rules -> one document of each near-duplicate group -> benchmark decontamination -> mixing to target
weights -> token-id shards. Every stage is written as Parquet and read again, so a lost executor
costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulcomp.llm import binary, common, decontaminate, jaccard, mixing, quality

#: Share of the tokens at hand that the mix takes, and how often a document may be repeated.
MIX_FRACTION, MIX_EPOCHS = 0.9, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_FRACTION, MIX_EPOCHS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return binary.write_shards(docs, common.fresh_folder(spark, "corpus-shards"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_to_weights", mix_to_weights),
    ("token_ids", token_ids),
]

#: Boosted trees and byte-pair encoding have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace('_', '-')}")
    return docs
