"""A training-data pipeline over ``documents`` in five stages, each one operator of webquarry.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as
the next one's docs. The first four return the columns of documents. Empty tables pass through; further columns are kept, and
columns of the pipeline's own begin with ``__wq_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webquarry.llm import decontam, langid, mixing, sharding, simhash
from webquarry.llm.common import written

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or letterless texts, or words of no clear language. Repeated rows are judged alike."""
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group, that of the smallest id; of rows that repeat it, one."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a benchmark item leaked, told apart by id and text: a clean row stays whose id a leaked one repeats. Null texts leak nothing."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin sources to their tempered weights, within the tokens there are. A null source is a source; each of repeated rows has its own uses."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mix to shards on the bounded-load ring, each use of a document to its own slot; the documents' columns follow the shard's."""
    return sharding.assign(docs, SHARDS, carry=True)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix),
    ("sharding", shard),
]

#: SQL can express neither the field's training, nor XXH64 fingerprints, nor the bisection.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
