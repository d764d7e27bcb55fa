"""A training-data pipeline over ``documents``: each stage calls one operator of this subpackage.

A stage takes (spark, docs, sf_dir) and returns the next stage's documents; all but the last return
the columns of ``documents``. Each stage's result is written as Parquet and read again; when the next
stage's is written it is deleted.

Defined results: null and empty texts are judged by the classifier like any other; of rows with equal
texts, or a repeated row, one stays after the near-duplicate stage, that of the least id (a null id
counts last); rows without an id or source go through every stage; an empty table gives an empty mix;
further columns, whatever their names, are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import decontam, mixing, neardup, pii, quality
from brightloom.llm.common import discard, scratch_dir
from brightloom.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.distinct_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with how many of their words and from which slot on."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
]

#: SQL can express neither the classifier nor its threshold; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before.append(path)
    return docs
