"""Corpus pipeline: language ID, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) with the columns of `documents` and returns what it keeps; its
output is written as Parquet and read again by the next. Further columns are left out at the first stage.
All stages take nulls in any column, empty texts, repeated ids and rows, and empty tables. No stage can be
put in SQL as a whole, so there is no ORACLE_SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, minhash, packing, pii
from tidemark.llm.common import materialise, text_batches
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that share no n-gram with any language.

    Ties stay. Null and empty texts have no letter and go. Where no document carries a language there is
    nothing to reject by: every document with a letter stays.
    """
    text_batches(spark)
    profiles = langid.train(docs.where(~langid.held_out()))
    seen = langid.predict(docs.select(*COLUMNS), profiles, shared=True)
    return seen.where("shared" if profiles else langid.any_letter("text")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near-duplicates, null ids last; one row of each class.

    Rows that share an id are told apart by their words.
    """
    text_batches(spark)
    return minhash.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms under the session's key; n_chars follows the text where it changed, null texts stay."""
    text_batches(spark)
    done = pii.pseudonymise(docs.select(*COLUMNS), pii.key_of(spark, demo=True))
    return done.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: of every piece its place and its token ids; null texts are a single end id."""
    text_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
