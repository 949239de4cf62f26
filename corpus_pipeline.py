"""The corpus pipeline: documents in, packed sequences out.

Stages, in order: documents that the quality classifier rejects go; repeated line runs go, and
documents that lose all their lines with them; one document of each near-duplicate group stays;
documents that hold benchmark passages go; the rest is packed. Every stage works on all rows
that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteaudit.llm import decontaminate, jaccard, line_dedup, packing, quality
from siteaudit.llm.queries import read, vocabulary
from siteaudit.plans.session import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, read(spark, sf_dir, "labels"))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_runs),
    ("jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

# The quality stage fits a model, which SQL cannot say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
