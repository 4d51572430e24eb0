"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundaflow.llm import mixing, neardup, packing, quality, queries, secrets
from fundaflow.llm.shared import table, with_flag
from fundaflow.session import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = quality.classified(docs, table(spark, sf_dir, "labels"))
    return with_flag(docs, "doc_id", judged.where("kept").select("doc_id").distinct())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id; five words, similarity 0.8."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    return with_flag(docs, "doc_id", found.where("kept").select("doc_id").distinct())


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text. Built-in functions only."""
    cleaned = secrets.masked(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages in their target shares of tokens: scarce ones repeat documents, none is thinned out."""
    labelled = queries.labelled_languages(spark, sf_dir, docs)
    return mixing.applied(docs, labelled, queries.TARGETS, least=1.0, whole=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two, none across documents."""
    return packing.packed(docs, queries.vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The trained classifiers, the components and the vocabulary are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
