"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns they were given. Each
works on whatever the one before kept, and its decisions take effect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.decontaminate import drop_contaminated
from docketry.llm.minmax_dedup import drop_near_duplicates
from docketry.llm.pivotal_mix import mix_documents
from docketry.llm.quality_rules import keep_good
from docketry.llm.queries import token_rows
from docketry.session import run_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and their index read back."""
    return token_rows(docs)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token files", tokens),
]

ORACLE_SQL = None  # byte-pair encoding and dependent rounding have no SQL; tests/llm compares by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{run_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{root}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
