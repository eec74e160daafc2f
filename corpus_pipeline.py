"""The corpus pipeline: five stages over documents, each an operator of loomline.llm; each one's result is written and read again.

Every stage but the last returns the columns of documents, so a stage can be run on any such table. The stages handle
nulls, empty texts, repeated rows and empty tables as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontamination, jaccard_join, language_id, mixing, sharding
from loomline.llm.common import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language explains."""
    return language_id.keep_identified(docs, language_id.sample(docs.where(~language_id.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the row of the smallest doc_id stays, else one of those without.

    Unlike texts are no copies, whether they have no doc_id or share one.
    """
    return jaccard_join.one_of_each(docs, k=5, num=4, den=5, one_per_id=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps nine tenths of all words, dealt to the sources by weight; no document is repeated."""
    return mixing.keep_mixed(docs, weights=(3.0, 1.0, 2.0), share=0.9)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns the documents to 40 shards of near equal bytes; equal texts stay together."""
    return sharding.shard_documents(docs, n_shards=40)


STAGES = [("language_id", identify_language), ("near_copies", drop_near_copies), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Cross-parsing, block-max WAND and hashed shuffles aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
