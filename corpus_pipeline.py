"""From raw documents to training tokens: the stages, each over all that the one before has kept.

Every stage but the last returns the columns of its input. `run` writes each result as Parquet and reads it again, in
the folder of spark.checkpoint.dir, so a lost executor costs work of the stage at hand only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexweave.llm.bpe import encoded
from plexweave.llm.common import Scratch, table
from plexweave.llm.exact_dedup import drop_copies
from plexweave.llm.mixing import training_order
from plexweave.llm.near_dedup import drop_near_copies
from plexweave.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the classifier learns from the labelled ones among them.

    Null and empty texts are judged as texts of no words, null languages by the common threshold; rows with a null id
    are never learned from. Without labels nothing is rejected. Repeated rows share their fate.
    """
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id. Null and empty texts are equal; rows with a null id are
    compared among themselves only."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Null and empty texts and null ids stay."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them. Texts without words are never taken; a null source is
    one of its own."""
    return training_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: the tokens of each document of the mix; none for a null or empty text."""
    return encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: The classifier and the library's tokens cannot be written in SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
