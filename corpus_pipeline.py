"""A corpus pipeline: each stage calls one operator of flowlens.llm, and what it
decides takes effect on the documents that the next stage reads.

All stages take texts of any length whole, give an empty table for an empty table,
and keep columns that they do not know, but for names that a stage says it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import decontaminate, langid, mixing, pii, probminhash
from flowlens.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without an identifiable language: null, empty and letterless
    texts, and those whose languages hold too small a share each. Rows without doc_id
    stay; all rows of a dropped doc_id go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest doc_id, and
    one row of each repeated doc_id. Texts without words are no copies of each other;
    rows without doc_id stay."""
    return probminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark. Null and empty texts hold
    none; rows without doc_id stay, and all rows of a dropped doc_id go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind and count n_chars again. Null texts stay null;
    every row is treated by itself."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample the target mixture of sources, languages and topics. Null and empty texts
    and rows without doc_id are never sampled; null sources and languages are a category
    of their own; rows with equal doc_ids are drawn alike. Writes mix_weight and
    mix_probability."""
    return mixing.sample(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Stages 1 to 3 are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
