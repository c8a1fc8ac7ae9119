"""Detections against target spans: interval join, per-stream summaries, pooled DET and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import ratio
from tidemark.operators.windows import lowest_of_last

#: Hops of a time slice of the interval join.
SLICE = 256


def interval_hits(fires: DataFrame, spans: DataFrame, tail: int = 0, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """keys, clip_no, start, hits: how many fires fall in [start, end + tail], both inclusive; 0 where none does.

    Spans are cut into slices of time, so the join has an equality on stream and slice however long a
    stream is, and a hot stream is many keys.
    """
    cut = spans.withColumn("until", F.col("end") + tail).withColumn("slice", F.explode(F.sequence(F.floor(F.col("start") / SLICE), F.floor((F.col("end") + tail) / SLICE))))
    met = cut.join(fires.withColumn("slice", F.floor(F.col("hop") / SLICE)), [*keys, "slice"], "left")
    inside = F.coalesce(F.col("hop").between(F.col("start"), F.col("until")), F.lit(False))
    return met.groupBy(*keys, "clip_no", "start").agg(F.count_if(inside).alias("hits"))


def fires_in_spans(fires: DataFrame, spans: DataFrame, tail: int = 0, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """The distinct fires that fall in at least one span."""
    cut = spans.select(*keys, "start", (F.col("end") + tail).alias("until"), F.explode(F.sequence(F.floor(F.col("start") / SLICE), F.floor((F.col("end") + tail) / SLICE))).alias("slice"))
    inside = F.col("hop").between(F.col("start"), F.col("until"))
    return fires.withColumn("slice", F.floor(F.col("hop") / SLICE)).join(cut, [*keys, "slice"]).where(inside).select(*keys, "hop").distinct()


def per_clip(fires: DataFrame, spans: DataFrame, tail: int, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """keys, clips, fired: how many spans there are and how many of them have a fire."""
    hits = interval_hits(fires, spans, tail, keys)
    return hits.groupBy(*keys).agg(F.count("*").alias("clips"), F.count_if(F.col("hits") > 0).alias("fired"))


def stream_summary(fires: DataFrame, spans: DataFrame, streams: DataFrame, tail: int = 0) -> DataFrame:
    """A row a stream and, with stream_id null, one a kind of stream.

    streams: stream_id, kind (positive, near_miss, background), hours of voice in it. On positive streams a
    span without a fire is a miss and a fire outside all spans a false accept. On the others every fire is a
    false accept, wherever it falls, and fa_per_clip is the share of spans with a fire; false accepts an hour
    are given for background streams only, 0 where there is no voice. What a kind has not is null.
    """
    clips = per_clip(fires, spans, tail)
    total = fires.groupBy("stream_id").agg(F.count("*").alias("fires"))
    inside = fires_in_spans(fires, spans, tail).groupBy("stream_id").agg(F.count("*").alias("inside"))
    joined = streams.select("stream_id", "kind", "hours").join(clips, "stream_id", "left").join(total, "stream_id", "left").join(inside, "stream_id", "left").na.fill(0, ["clips", "fired", "fires", "inside"])
    pooled = joined.groupingSets([["stream_id", "kind"], ["kind"]], "stream_id", "kind").agg(*(F.sum(c).alias(c) for c in ("clips", "fired", "fires", "inside", "hours")))
    positive, background = F.col("kind") == "positive", F.col("kind") == "background"
    misses, share = F.col("clips") - F.col("fired"), lambda n: ratio(n.cast("double"), F.col("clips"))
    false = F.when(positive, F.col("fires") - F.col("inside")).otherwise(F.col("fires"))
    return pooled.select(
        "stream_id", "kind", "clips", F.when(positive, misses).alias("misses"), F.when(positive, share(misses)).alias("miss_rate"), "fires", false.alias("false_accepts"),
        F.when(~positive, share(F.col("fired"))).alias("fa_per_clip"), "hours", F.when(background, ratio(F.col("fires").cast("double"), F.col("hours"))).alias("fa_per_hour"),
    )


def at_thresholds(hops: DataFrame, steps: list[int], of: int, k: int = 1) -> DataFrame:
    """stream_id, step, hop of all candidates of each threshold step/of: one pass, a candidate for each threshold it reaches.

    With k the last k scores must reach it, so the least of them counts.
    """
    s = F.col("score")
    if k > 1:
        hops = lowest_of_last(hops, k)
    grid = F.array(*(F.lit(i) for i in steps))
    reached = F.filter(grid, lambda i: (s >= i / F.lit(float(of))) & ~F.isnan(s))
    return hops.where(s.isNotNull()).select("stream_id", "hop", F.explode(reached).alias("step"))


def pooled_det(fires: DataFrame, spans: DataFrame, streams: DataFrame, steps: DataFrame, tail: int = 0) -> DataFrame:
    """step, misses, clips, miss_rate, near_miss_rate, false_accepts, fa_per_hour over all streams of a kind.

    Misses come from positive streams, false accepts and hours from background ones; near-miss streams give the
    share of their spans that fired, null where they have none. streams: stream_id, kind, hours. fires:
    stream_id, step, hop. steps: step.
    """
    kinds = streams.select("stream_id", "kind")
    wanted = spans.join(kinds.where("kind <> 'background'"), "stream_id").join(F.broadcast(steps))  # a fixed list of steps
    clips = per_clip(fires, wanted.drop("kind"), tail, ("stream_id", "step")).join(kinds, "stream_id")
    of = lambda kind, column: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))
    hit = clips.groupBy("step").agg(of("positive", "clips").alias("clips"), of("positive", "fired").alias("fired"), of("near_miss", "clips").alias("near"), of("near_miss", "fired").alias("near_fired"))
    background = streams.where("kind = 'background'")
    false = fires.join(background.select("stream_id"), "stream_id", "left_semi").groupBy("step").agg(F.count("*").alias("false_accepts"))
    length = background.agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"))
    rows = steps.join(hit, "step", "left").join(false, "step", "left").na.fill(0).join(F.broadcast(length))
    misses = F.col("clips") - F.col("fired")
    return rows.select(
        "step", misses.alias("misses"), "clips", ratio(misses.cast("double"), F.col("clips")).alias("miss_rate"), F.when(F.col("near") > 0, F.col("near_fired") / F.col("near")).alias("near_miss_rate"),
        "false_accepts", ratio(F.col("false_accepts").cast("double"), F.col("hours")).alias("fa_per_hour"),
    )


def verified_hops(hops: DataFrame, verifier: str, threshold: float) -> DataFrame:
    """Hops with score 0 where the second stage rejects: before runs and debounce, so that a rejection breaks a run."""
    return hops.withColumn("score", reject(F.col("score"), F.coalesce(verifier, F.lit(0.0)), threshold))


def select_point(det: DataFrame, target: float) -> DataFrame:
    """The row of least miss rate within the target, ties to the highest step; else of least (fa_per_hour, miss_rate), then the first."""
    within = F.col("fa_per_hour") <= target
    order = Window.orderBy(F.when(within, 0).otherwise(1), F.when(within, F.col("miss_rate")).otherwise(F.col("fa_per_hour")), F.when(within, -F.col("step")).otherwise(0), "miss_rate", "step")
    return det.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").withColumn("within", within)


def verified(hops: DataFrame, scores: DataFrame, fires: DataFrame) -> DataFrame:
    """Second-stage scores for the hops that fired only: the rest is never scored."""
    return hops.join(fires.select("stream_id", "hop"), ["stream_id", "hop"], "left_semi").join(scores, ["stream_id", "hop"], "left").na.fill(0.0, ["verifier_score"])


def reject(score: Column, verifier: Column, threshold: float) -> Column:
    return F.when(verifier >= threshold, score).otherwise(F.lit(0.0))


def verifier_by_name(triggers: DataFrame, verifiers: DataFrame) -> DataFrame:
    """Add `verifier`: the one of the trigger's name, else the only one there is, else null."""
    only = verifiers.agg(F.when(F.count("*") == 1, F.max("verifier")).alias("only"))
    named = triggers.join(verifiers.withColumnRenamed("name", "__name"), triggers["name"] == F.col("__name"), "left").drop("__name")
    return named.join(F.broadcast(only)).withColumn("verifier", F.coalesce("verifier", "only")).drop("only")
