"""The corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir); ``docs`` is what its predecessor kept,
written as Parquet and read again.  All but the last return the columns of
``documents``.  Models and statistics of a stage come from its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import table
from riskframe.llm.decontam import without_leaks
from riskframe.llm.mixing import mix_documents
from riskframe.llm.neardup import without_near_copies
from riskframe.llm.sharding import shard_documents
from riskframe.llm.toxicity import without_toxic
from riskframe.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot, 24 shards of nearly equal bytes."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: toxicity and near duplicates have no SQL form; tests/llm compares each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
