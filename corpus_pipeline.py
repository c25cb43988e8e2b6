"""A pipeline over documents: each stage works on all that its predecessor kept, and its decisions take effect.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from sylvan.llm.common import collected_by_executors, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels of this folder."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced in the texts."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of token windows. The workers' tables are small, as the stages before leave large JVMs behind."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), kept=100_000, batch=1 << 19)


def begun(stage):
    """The stage, begun with what the one before left in the executors' heaps collected."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected_by_executors(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("toxicity", begun(drop_toxic)), ("exact_dedup", begun(drop_copies)), ("jaccard_join", begun(drop_near_copies)), ("pii", begun(sanitise)), ("packing", begun(pack))]

#: Models and tokenizers are not SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
