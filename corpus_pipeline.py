"""The corpus pipeline: documents in, packed training sequences out, each stage written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageflow.llm import op2_packing, op3_pii, op4_simhash, op8_language
from pageflow.llm.queries import WORD_MODEL, packed, table
from pageflow.session import materialise

#: Least share of a text's letters that its language must have.
MIN_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language of their own; labels of the other thirds train the model."""
    return op8_language.keep_identified(docs, op8_language.train(docs, op8_language.third()), MIN_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return op4_simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind; n_chars follows."""
    return op3_pii.mask_column(docs, op3_pii.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of all texts in windows: one row per piece."""
    return packed(op2_packing.pack_documents(docs, public_tokenizers.path(WORD_MODEL)))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: No SQL: the stages run trained models and a stateful packer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
