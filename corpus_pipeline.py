"""The corpus pipeline: five stages over the documents, each written as Parquet and read again for the next.

A stage is a function (spark, docs, sf_dir) that returns a DataFrame with the columns of documents; the last one returns the packed
pieces. Rows that repeat in full count as copies of one document; null and empty texts have no language and are rejected by
the first stage; an empty table passes through every stage; further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import language, minhash, mixing, packing, secrets
from merchlake.llm.common import findable, table, unpacked
from merchlake.shared import forget, materialize, scratch

#: Documents stay whose language has at least this calibrated probability: short texts full of numbers and addresses reach little more than
#: chance and are right all the same.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; it learns from the labelled documents that are not held out."""
    model = language.fit(docs.where(~language.held_out()))
    told = language.predicted(docs, model).where((F.col("lang") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return unpacked(told, docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.deduplicate(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by their kinds; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream by position: documents beyond their source's target go, others come once per pass."""
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences and places."""
    return packing.op5_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Languages, near-duplicates and tokens are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage and its operators have written is deleted as soon as the next one has been."""
    findable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        forget(before)
    return docs
