"""Feature tables: class-tagged training examples, validation bundles, verifier tests, streams of features.

An example is `features`, an array of steps that are arrays of `dim` numbers. A table of single steps (`emb`
and `hop`) is a continuous stream. Folders that are not there are left out with a warning.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import reblock
from tidemark.sources.sinks import exists, present
from tidemark.sources.tables import CLIP_SECONDS, HOP_SECONDS, WINDOW_STEPS


def checked(examples: DataFrame, steps: int | None, dim: int, name: str) -> DataFrame:
    """Examples of `steps` steps of `dim` numbers: the last steps of longer ones; anything else raises. Without `steps` as they are."""
    wrong = F.raise_error(F.lit(f"{name}: a step that has not {dim} numbers")).cast("array<array<double>>")
    short = F.raise_error(F.lit(f"{name}: an example of fewer than {steps} steps")).cast("array<array<double>>")
    kept = F.col("features").cast("array<array<double>>") if steps is None else F.when(F.size("features") < steps, short).otherwise(last_steps(F.col("features"), steps))
    return examples.withColumn("features", F.when(F.forall("features", lambda s: F.size(s) == dim), kept).otherwise(wrong))


def last_steps(features: Column, steps: int = WINDOW_STEPS) -> Column:
    """The last steps of an example, all of a shorter one."""
    x = features.cast("array<array<double>>")
    return F.slice(x, F.greatest(F.lit(1), F.size(x) - steps + 1), F.lit(steps))


def examples_of(table: DataFrame, steps: int, dim: int, name: str) -> DataFrame:
    """features of a table: a stream is cut into blocks without overlap, its rest dropped."""
    if "features" in table.columns:
        return checked(table.select("features"), steps, dim, name)
    own = F.col("stream_id") if "stream_id" in table.columns else F.lit(0).alias("stream_id")
    blocks = reblock(table.select(own, "hop", "emb"), "emb", steps)
    return checked(blocks.select(F.col("rows").alias("features")), steps, dim, name)


def tagged_examples(spark: SparkSession, paths: dict[str, str], steps: int = WINDOW_STEPS, dim: int = 96) -> DataFrame:
    """cls, class_id, features of all classes; class_id is the class's place among the paths. Raises where no table is there."""
    places = {name: i for i, name in enumerate(paths)}
    parts = [examples_of(spark.read.parquet(path), steps, dim, name).select(F.lit(name).alias("cls"), F.lit(places[name]).alias("class_id"), "features") for name, path in present(spark, paths).items()]
    if not parts:
        raise FileNotFoundError("no table of features")
    return functools.reduce(DataFrame.unionByName, parts)


@dataclass
class Validation:
    """Positive clips, negative clips, the hours these last, and a continuous negative stream."""

    positive: DataFrame
    negative: DataFrame
    clip_hours: DataFrame
    stream: DataFrame

    def stream_hours(self, steps: int = WINDOW_STEPS) -> DataFrame:
        """One row: hours of the windows that the stream has."""
        rows = self.stream.groupBy("stream_id").agg(F.greatest(F.lit(0), F.count("*") - steps + 1).alias("n"))
        return rows.agg((F.coalesce(F.sum("n"), F.lit(0)) * HOP_SECONDS / 3600).alias("stream_hours"))


def validation(spark: SparkSession, positive: str, negatives: list[str], background: str | None = None, dim: int = 96, clip_seconds: float = CLIP_SECONDS) -> Validation:
    """The tables of a validation. A background table of single steps is the stream, one of examples more negative clips."""
    none = spark.createDataFrame([], "features array<array<double>>")
    read = lambda path: checked(spark.read.parquet(path).select("features"), None, dim, path) if exists(spark, path) else none
    negative = functools.reduce(DataFrame.unionByName, [read(p) for p in negatives], none)
    stream = spark.createDataFrame([], "stream_id long, hop long, emb array<double>")
    if background and exists(spark, background):
        table = spark.read.parquet(background)
        if "features" in table.columns:
            negative = negative.unionByName(read(background))
        else:
            stream = table.select("stream_id", "hop", F.col("emb").cast("array<double>").alias("emb"))
    hours = negative.agg((F.count("*") * clip_seconds / 3600).alias("clip_hours"))
    return Validation(read(positive), negative, hours, stream)


def verifier_test(spark: SparkSession, positive: str, near_miss: str, steps: int = WINDOW_STEPS) -> DataFrame:
    """kind, features: positive and near-miss test clips, their last steps."""
    parts = [spark.read.parquet(path).select(F.lit(kind).alias("kind"), last_steps(F.col("features"), steps).alias("features")) for kind, path in (("positive", positive), ("near_miss", near_miss)) if exists(spark, path)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "kind string, features array<array<double>>")


def required(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raise where one of the tables is missing."""
    for name, path in paths.items():
        if not exists(spark, path):
            raise FileNotFoundError(f"{name}: nothing at {path}")


def class_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
