"""Pronunciation dictionaries: word and phonemes, the first pronunciation of each word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, phones of a text file with a word and its phonemes a line.

    Lines that begin with ;;; are comments. A further pronunciation has a number in parentheses after the word,
    or repeats the word; of each word the unnumbered one, or else the first in order of number and text, is kept.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith(";;;"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 1)
    named = parts.select(F.lower(F.regexp_replace(F.col("p")[0], r"\(\d+\)$", "")).alias("word"), F.coalesce(F.try_to_number(F.regexp_extract(F.col("p")[0], r"\((\d+)\)$", 1), F.lit("999")).cast("int"), F.lit(0)).alias("number"), F.slice("p", 2, 1000).alias("phones"))
    first = Window.partitionBy("word").orderBy("number", F.array_join("phones", " "))
    return named.withColumn("r", F.row_number().over(first)).where("r = 1").select("word", "phones")


def spelled_dictionary(vocabulary: DataFrame) -> DataFrame:
    """word, phones by a plain rule of spelling, where no dictionary is at hand.

    A run of vowels is one stressed phoneme named by its first letter, c and q sound as k, every other letter
    is a phoneme of its own.
    """
    runs = F.regexp_extract_all("word", F.lit("([aeiouy]+|[^aeiouy])"), 1)
    phone = lambda r: F.when(r.rlike("^[aeiouy]"), F.concat(F.upper(F.substring(r, 1, 1)), F.lit("1"))).otherwise(F.upper(F.translate(r, "cq", "kk")))
    return vocabulary.select("word", F.transform(runs, phone).alias("phones"))
