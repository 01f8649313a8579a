"""A corpus pipeline of five of the subpackage's operators.

Toxic documents go, then exact copies, then near duplicates (one document of
each group stays); what is left is mixed to its sources' target weights and
encoded for training. Each stage reads what the one before wrote. Executors
keep what the largest of their batches took, so the stages' passes over whole
texts take small ones, and their results are written within the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import materialise, small_batches, table
from platewise.llm.exact_dedup import drop_copies
from platewise.llm.minhash import drop_near_duplicates
from platewise.llm.mixing import mixed_documents
from platewise.llm.sentencepiece_sa import encode_documents
from platewise.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent scorer, fitted on the labelled rows of
    ``docs``, doesn't predict toxic."""
    with small_batches(spark):
        return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    with small_batches(spark):
        return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 or more."""
    with small_batches(spark):
        return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with digests of the ids and of the text they
    decode to."""
    with small_batches(spark):
        return materialise(encode_documents(docs, piece_bytes=1 << 20).drop("row_key"), "pipeline-encoded")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("encoding", encoding)]

#: The scorer's and the rounding's results can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
