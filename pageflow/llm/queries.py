"""Registered queries of the operators in this folder, over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import op1_covertree, op10_digest, op11_merkle, op12_quality, op13_divergence, op2_packing, op3_pii, op4_simhash, op5_pieces, op6_warc, op7_huffman, op8_language, op9_counts

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # bounds what a Python worker holds of one batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_covertree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(op2_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL)))


def packed(pieces: DataFrame) -> DataFrame:
    """Pieces with a digest in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op3_pii.detect(docs, op3_pii.train(docs))


def op4_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op6_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_warc.read_warc(op6_warc.write_warc(table(spark, sf_dir, "pages")))


def op7_huffman_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_huffman.read_ids(op7_huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL)))


def op8_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op8_language.identify(docs, op8_language.train(docs, op8_language.third()))
    return found.select("doc_id", op8_language.third().alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op10_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_digest.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_merkle.verify_documents(table(spark, sf_dir, "documents"))


#: Least score of the label 1.
GOOD = 0.3


def op12_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = op12_quality.score(docs, op12_quality.train(docs, labels, op12_quality.fifth()))
    return found.select("doc_id", op12_quality.fifth().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op13_divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_covertree_topk": op1_covertree_query,
        "op2_packing": op2_packing_query,
        "op3_pii": op3_pii_query,
        "op4_simhash": op4_simhash_query,
        "op5_sentencepiece": op5_pieces_query,
        "op6_warc": op6_warc_query,
        "op7_token_ids": op7_huffman_query,
        "op8_language_id": op8_language_query,
        "op9_token_counts": op9_token_counts,
        "op10_digest": op10_digest_query,
        "op11_merkle": op11_merkle_query,
        "op12_quality": op12_quality_query,
        "op13_divergence": op13_divergence_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_covertree_topk": op1_covertree.ORACLE, "op6_warc": op6_warc.ORACLE, "op11_merkle": op11_merkle.ORACLE, "op13_divergence": op13_divergence.ORACLE}
