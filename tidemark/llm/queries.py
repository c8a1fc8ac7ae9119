"""Queries of the training-data operators, by the names that __spark_entry__ registers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, langid, minhash, packing, pii, sharding, tokencount, topk, wrappers
from tidemark.llm.common import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are; TIDEMARK_TOKENIZERS names another folder."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark, demo=True))


def op3_inferred_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), profiles).drop("text")


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op8_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sorted_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), 49407)


QUERIES = {f.__name__: f for f in (op1_prob_minhash, op2_feistel_pseudonyms, op3_inferred_wrappers, op4_canonical_digest, op5_best_fit_packing, op6_rank_profiles, op7_external_shuffle, op8_streaming_bpe, op9_sorted_list_topk, op10_separator_scan)}
ORACLE_SQL: dict[str, str] = {}
