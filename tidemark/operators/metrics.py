"""Rates, threshold sweeps, DET curves and operating points.

Scores of NaN or null never pass a threshold. Hours of zero or less give an infinite false-positive rate,
an empty side gives a rate of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import HOP_SECONDS


def passes(score: Column, threshold) -> Column:
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_hour(count: Column, hours: Column) -> Column:
    return F.when(hours <= 0, F.lit(float("inf"))).otherwise(count / hours)


def clip_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row from kind (positive, near_miss, background) and score: a single pass with partial sums."""
    hit, kind = passes(F.col("score"), threshold), F.col("kind")
    n = lambda c: F.count_if(c).cast("double")
    sums = scores.agg(
        n(kind == "positive").alias("p"), n((kind == "positive") & hit).alias("tp"), n(kind != "positive").alias("q"), n((kind != "positive") & hit).alias("fp"),
        n(kind == "near_miss").alias("m"), n((kind == "near_miss") & hit).alias("mp"), n(kind == "background").alias("b"), n((kind == "background") & hit).alias("bp"),
    )
    tpr, fpr = ratio(F.col("tp"), F.col("p")), ratio(F.col("fp"), F.col("q"))
    tnr = F.when(F.col("q") > 0, 1 - fpr).otherwise(0.0)
    return sums.select(
        tpr.alias("recall"), per_hour(F.col("bp"), F.col("b") * HOP_SECONDS / 3600).alias("fpph"), ((tpr + tnr) / 2).alias("accuracy"),
        ratio(F.col("mp"), F.col("m")).alias("near_miss_rate"), F.col("p").cast("long").alias("positives"), F.col("q").cast("long").alias("negatives"),
    )


def stream_metrics(clips: DataFrame, hops: DataFrame, fires: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics with a continuous negative stream: false positives an hour are its debounced fires.

    clips: kind, score; hops: score of the negative stream; fires: its detections. Negative clips give the
    near-miss rate, and accuracy has clips and hops together for its negative side.
    """
    sides = clips.select("kind", "score").unionByName(hops.select(F.lit("hop").alias("kind"), "score"))
    hit, kind = passes(F.col("score"), threshold), F.col("kind")
    n = lambda c: F.count_if(c).cast("double")
    sums = sides.agg(
        n(kind == "positive").alias("p"), n((kind == "positive") & hit).alias("tp"), n(kind != "positive").alias("q"), n((kind != "positive") & hit).alias("fp"),
        n(~kind.isin("positive", "hop")).alias("m"), n(~kind.isin("positive", "hop") & hit).alias("mp"), n(kind == "hop").alias("hops"),
    )
    counted = sums.join(F.broadcast(fires.agg(F.count("*").alias("fires"))))  # one row
    return counted.select(*_rates("fires", "hops"))


def _rates(fires: str, hops: str) -> list[Column]:
    tpr, fpr = ratio(F.col("tp"), F.col("p")), ratio(F.col("fp"), F.col("q"))
    return [
        per_hour(F.col(fires), F.col(hops) * HOP_SECONDS / 3600).alias("fpph"), ratio(F.col("mp"), F.col("m")).alias("near_miss_rate"), tpr.alias("recall"),
        ((tpr + F.when(F.col("q") > 0, 1 - fpr).otherwise(0.0)) / 2).alias("accuracy"),
    ]


def stream_sweep(clips: DataFrame, hops: DataFrame, fires: DataFrame, steps: int = 100, first: int = 1, last: int = 99) -> DataFrame:
    """`stream_metrics` at thresholds first/steps to last/steps, with fpr; fires: step, and a row for each detection at it."""
    spark = clips.sparkSession
    sides = {"p": clips.where("kind = 'positive'"), "m": clips.where("kind <> 'positive'"), "h": hops}
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step"))  # steps + 1 rows
    for name, rows in sides.items():
        counts = bucketed(rows.select(F.lit("positive").alias("kind"), "score"), steps).select("step", F.col("positive").alias(name))
        grid = grid.join(counts, "step", "left").na.fill(0, [name])
    hit = grid.select("step", F.sum("p").over(above).alias("tp"), F.sum("m").over(above).alias("mp"), F.sum("h").over(above).alias("hp"))
    for name, rows in sides.items():
        hit = hit.join(F.broadcast(rows.agg(F.count("score").cast("double").alias({"p": "p", "m": "m", "h": "hops"}[name]))))  # one row
    hit = hit.where(F.col("step").between(first, last)).join(F.broadcast(fires.groupBy("step").agg(F.count("*").alias("fires"))), "step", "left").na.fill(0, ["fires"])
    hit = hit.withColumn("q", F.col("m") + F.col("hops")).withColumn("fp", F.col("mp") + F.col("hp"))
    return hit.select("step", (F.col("step") / F.lit(float(steps))).alias("threshold"), ratio(F.col("fp"), F.col("q")).alias("fpr"), *_rates("fires", "hops"))


def bucketed(scores: DataFrame, steps: int) -> DataFrame:
    """step, positive, negative: how many scores reach exactly threshold step/steps and no higher one.

    Every score is placed once, against the thresholds as doubles, so a sweep costs one pass.
    """
    s, n = F.col("score"), F.lit(float(steps))
    guess = F.floor(F.greatest(F.lit(0.0), F.least(s, F.lit(1.0))) * steps)
    step = F.when((guess + 1) / n <= s, guess + 1).when(guess / n > s, guess - 1).otherwise(guess)
    placed = scores.where(s.isNotNull() & ~F.isnan(s)).select(F.least(step, F.lit(steps)).cast("int").alias("step"), "kind")
    return placed.groupBy("step").agg(F.count_if(F.col("kind") == "positive").alias("positive"), F.count_if(F.col("kind") != "positive").alias("negative"))


def sweep(scores: DataFrame, steps: int = 100, first: int = 1, last: int = 99, hours: float | None = None) -> DataFrame:
    """step, threshold, recall, fpr, fpph, accuracy at thresholds first/steps to last/steps."""
    spark = scores.sparkSession
    counts = bucketed(scores, steps)
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").na.fill(0, ["positive", "negative"])
    # steps + 1 rows: running sums from the top in one small partition
    above = Window.orderBy(F.desc("step"))
    sums = grid.select("step", F.sum("positive").over(above).alias("tp"), F.sum("negative").over(above).alias("fp"))
    totals = scores.agg(F.count_if(F.col("kind") == "positive").cast("double").alias("p"), F.count_if(F.col("kind") != "positive").cast("double").alias("q"))
    sums = sums.join(F.broadcast(totals))  # one row
    tpr, fpr = ratio(F.col("tp"), F.col("p")), ratio(F.col("fp"), F.col("q"))
    length = F.lit(hours) if hours is not None else F.col("q") * HOP_SECONDS / 3600
    return sums.where(F.col("step").between(first, last)).select(
        "step", (F.col("step") / F.lit(float(steps))).alias("threshold"), tpr.alias("recall"), fpr.alias("fpr"), per_hour(F.col("fp"), length).alias("fpph"),
        ((tpr + F.when(F.col("q") > 0, 1 - fpr).otherwise(0.0)) / 2).alias("accuracy"),
    )


def latency_percentiles(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, n, p50, p95, p99 by linear interpolation."""
    return rows.groupBy(*keys).agg(F.count(column).alias("n"), *(F.percentile(column, F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)))


def best_thresholds(swept: DataFrame, targets: list[float], least_recall: float = 0.5, middle: int = 50) -> DataFrame:
    """target, threshold, tier for each target of false positives an hour.

    Tier 1: highest recall among points within the target and of enough recall; tier 2: highest accuracy
    among points of enough recall; tier 3: the step `middle`, threshold 0.5. Ties go to the lowest threshold.
    """
    spark = swept.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    enough = F.col("recall") >= least_recall
    tier = F.when(enough & (F.col("fpph") <= F.col("target")), 1).when(enough, 2).otherwise(3)
    merit = F.when(F.col("tier") == 1, F.col("recall")).when(F.col("tier") == 2, F.col("accuracy")).otherwise(-F.abs(F.col("step") - middle))
    order = Window.partitionBy("target").orderBy("tier", F.desc("merit"), "threshold")
    ranked = swept.join(F.broadcast(wanted)).withColumn("tier", tier).withColumn("merit", merit).withColumn("r", F.row_number().over(order))
    return ranked.where("r = 1").select("target", "tier", "threshold", "recall", "fpph", "accuracy")


def det_curve(scores: DataFrame, steps: int = 1000) -> DataFrame:
    """threshold, fpr, fnr at steps + 1 points."""
    return sweep(scores, steps, 0, steps).select("threshold", "fpr", (1 - F.col("recall")).alias("fnr"))


def area_under_det(curve: DataFrame) -> DataFrame:
    """Trapezoids of the miss rate over the false-positive rate, ordered by (fpr, fnr descending)."""
    order = Window.orderBy("fpr", F.desc("fnr"))
    part = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("fnr") + F.lag("fnr").over(order)) / 2
    return curve.select(part.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("aut"))


def recall_threshold(scores: DataFrame, targets: list[float]) -> DataFrame:
    """target, threshold, recall, near_miss_accept: the k-th highest positive score, k = ceil(target * n)."""
    chosen = kth_highest(scores.where((F.col("kind") == "positive") & F.col("score").isNotNull()).select("score"), targets)
    hit = passes(F.col("score"), F.col("threshold")).cast("double")
    rates = scores.join(F.broadcast(chosen)).groupBy("target", "threshold").agg(
        F.avg(F.when(F.col("kind") == "positive", hit)).alias("recall"), F.coalesce(F.avg(F.when(F.col("kind") == "near_miss", hit)), F.lit(0.0)).alias("near_miss_accept")
    )
    return rates


#: Buckets of scores from 0 to 1 in which a rank is looked for.
RANK_BUCKETS = 4096


def kth_highest(scores: DataFrame, targets: list[float]) -> DataFrame:
    """target, threshold: the k-th highest score, k = ceil(target * n), one at least; NaN counts as lowest.

    Counts by bucket of the score tell which bucket holds rank k; only that bucket is put in order.
    """
    spark = scores.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    bucket = F.floor(F.greatest(F.lit(-1.0), F.least(value, F.lit(1.0))) * RANK_BUCKETS)
    placed = scores.select(value.alias("score"), bucket.alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("bucket"))))  # a row a bucket, 8,193 at most
    total = counts.agg(F.sum("n").alias("total"))
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("target") * F.col("total"), 9)))
    spot = upto.join(F.broadcast(wanted.join(F.broadcast(total)).select("target", k.alias("k")))).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    inside = placed.join(F.broadcast(spot.select("target", "bucket", (F.col("k") - F.col("upto") + F.col("n")).alias("place"))), "bucket")
    equal = inside.groupBy("target", "place", "score").agg(F.count("*").alias("n"))
    ranked = equal.withColumn("upto", F.sum("n").over(Window.partitionBy("target").orderBy(F.desc("score"))))
    return ranked.where(F.col("upto") >= F.col("place")).groupBy("target").agg(F.max("score").alias("threshold"))


def percentile_filter(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints of step, recall, fpph, accuracy within the best tenths of all three; else the best recall."""
    limits = checkpoints.agg(F.percentile("fpph", F.lit(0.1)).alias("f"), F.percentile("recall", F.lit(0.9)).alias("r"), F.percentile("accuracy", F.lit(0.9)).alias("a"))
    marked = checkpoints.join(F.broadcast(limits)).withColumn("good", (F.col("fpph") <= F.col("f")) & (F.col("recall") >= F.col("r")) & (F.col("accuracy") >= F.col("a")))
    everything = Window.partitionBy(F.lit(1))
    best = Window.orderBy(F.desc("recall"), "step")
    marked = marked.withColumn("any_good", F.max("good").over(everything)).withColumn("place", F.row_number().over(best))
    return marked.where(F.col("good") | ~F.col("any_good") & (F.col("place") == 1)).select("step", "recall", "fpph", "accuracy", "good")


def average_weights(weights: DataFrame) -> DataFrame:
    """Element-wise mean of `weights` arrays by `name`."""
    flat = weights.select("name", F.posexplode("weights").alias("i", "w"))
    means = flat.groupBy("name", "i").agg(F.avg("w").alias("w"))
    return means.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("weights"))


def smoothed(label: Column, epsilon: float) -> Column:
    return label * (1 - epsilon) + epsilon / 2


def negative_weight(label: Column, weight: Column) -> Column:
    return F.when(label < 0.5, weight).otherwise(1.0)


def focal_loss(probability: Column, label: Column, gamma: float = 2.0, floor: float = 1e-7) -> Column:
    """Cross entropy times (1 - p of what is right) ** gamma, for labels between 0 and 1 too."""
    p = F.greatest(F.lit(floor), F.least(probability, F.lit(1 - floor)))
    right = p * label + (1 - p) * (1 - label)
    return -F.pow(1 - right, gamma) * (label * F.log(p) + (1 - label) * F.log(1 - p))
