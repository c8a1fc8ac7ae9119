"""Readers and the streams derived from the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a hop, hops of a scored window, samples of a hop and a second, seconds of a clip.
HOP_SECONDS, WINDOW_STEPS, HOP_SAMPLES, SAMPLE_RATE, CLIP_SECONDS = 0.08, 16, 1280, 16_000, 2.0


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hop_scores(events: DataFrame) -> DataFrame:
    """stream_id, hop, event_id, kind, value, score: one stream a user, hops in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "near_miss").otherwise("background")
    return events.select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("hop"), "event_id",
        kind.alias("kind"), "value", (F.col("value") / (F.col("value") + 50.0)).alias("score"),
    )


def clip_scores(events: DataFrame) -> DataFrame:
    """kind, score without an order: no shuffle."""
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "near_miss").otherwise("background")
    return events.select("event_id", kind.alias("kind"), (F.col("value") / (F.col("value") + 50.0)).alias("score"))


def embedding_stream(embeddings: DataFrame) -> DataFrame:
    """stream_id, hop, vec_id, emb: one stream a label, hops in order of vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return embeddings.select(F.col("label").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("hop"), "vec_id", F.col("embedding").cast("array<double>").alias("emb"))


def targets(hops: DataFrame, length: int = 2) -> DataFrame:
    """stream_id, clip_no, start, end in hops: every positive event is a target of `length` hops more."""
    return hops.where(F.col("kind") == "positive").select("stream_id", F.col("event_id").alias("clip_no"), F.col("hop").alias("start"), (F.col("hop") + length).alias("end"))


def streams(hops: DataFrame, voice: float = 0.1) -> DataFrame:
    """stream_id, kind, hours of all streams: a stream is of its first hop's kind, hops that score `voice` or more are voiced."""
    rows = hops.groupBy("stream_id").agg(F.min_by("kind", "hop").alias("kind"), F.count_if(F.col("score") >= voice).alias("voiced"))
    return rows.select("stream_id", "kind", (F.col("voiced") * HOP_SECONDS / 3600).alias("hours"))


def stream_clips(hops: DataFrame, streams: DataFrame, length: int = 2) -> DataFrame:
    """stream_id, clip_no, start, end in hops: in every stream the events of its own kind, each `length` hops more."""
    own = hops.withColumnRenamed("kind", "event_kind").join(streams.select("stream_id", "kind"), "stream_id").where("event_kind = kind")
    return own.select("stream_id", F.col("event_id").alias("clip_no"), F.col("hop").alias("start"), (F.col("hop") + length).alias("end"))


def chunks(hops: DataFrame, column: str = "value", size: int = 7) -> DataFrame:
    """stream_id, seq, samples: a stream's values, so many at a time, as a device would send them."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("hop", F.col(column).cast("double").alias("x")))), lambda r: r["x"])
    return hops.groupBy("stream_id", F.floor(F.col("hop") / size).alias("seq")).agg(rows.alias("samples"))


def share(key: Column, purpose: str, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on seed, purpose and key alone: the same in every engine with md5."""
    return F.conv(F.substring(order_key(key, purpose, seed), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def order_key(key: Column, purpose: str, seed: int = 7) -> Column:
    """A text to sort by in place of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), key.cast("string")).cast("binary"))
