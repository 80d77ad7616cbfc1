"""The training-data pipeline: five stages over ``documents``, each stage's result
written as Parquet and read again as the next one's input.

1. quality rules: documents that the base rules or a certified cutoff reject go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. benchmark decontamination: documents with a benchmark passage go;
4. mixing: the documents in the order of the Pfair schedule of their sources;
5. sharding: shard and slot of every document, from its place in that order.

The first four return the columns of their input.  The order of stage four is the
stored order of its files, which stage five numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import decontam, jaccard, mixing, quality, sharding
from stockroom.llm.common import load
from stockroom.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, stored_order=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# The keyed permutation works on wrapping 64-bit words, and the join's sets on hashes:
# SQL can't state the last stage; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
