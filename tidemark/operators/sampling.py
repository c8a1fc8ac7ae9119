"""Deterministic sampling: every draw is a hash of seed, purpose and key, so a resumed run draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import signal
from tidemark.sources.tables import order_key, share


def numbered(rows: DataFrame, out: str, bucket: Column, order: list, groups: tuple[str, ...] = ()) -> DataFrame:
    """Add `out`, the place from 0 in order within the groups. bucket: a number or text that rises along the order.

    Buckets are counted and their counts summed, a row a bucket and group; rows are put in order within one
    bucket each, so no group and no table is one task's work.
    """
    placed = rows.withColumn("__bucket", bucket)
    counts = placed.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*order)
    met = placed.withColumn("__inside", F.row_number().over(inside)).alias("l").join(starts.alias("r"), on=[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*groups, "__bucket")])
    kept = [F.col(f"l.{c}") for c in rows.columns if c != out]
    return met.select(*kept, (F.col("r.__start") + F.col("l.__inside") - 1).alias(out))


def ranked(rows: DataFrame, key: str, purpose: str, *groups: str) -> DataFrame:
    """Add rank (from 0) in hashed order within the groups."""
    hashed = order_key(F.col(key), purpose)
    return numbered(rows, "rank", F.substring(hashed, 1, 3), [order_key(F.col(key), purpose), key], groups)


def sample(rows: DataFrame, key: str, n: int, *groups: str, purpose: str = "sample") -> DataFrame:
    """n rows of each group without replacement."""
    return ranked(rows, key, purpose, *groups).where(F.col("rank") < n).drop("rank")


def top_n(rows: DataFrame, n: int, by: list[str], *groups: str) -> DataFrame:
    """The n rows of each group that come last in order; each task first cuts its own rows to n."""
    order = Window.partitionBy(*groups).orderBy(*(F.desc(c) for c in by))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def cyclic_batches(rows: DataFrame, shares: dict[str, int], batches: int) -> DataFrame:
    """batch, cls, k and the row dealt: each class gives shares[class] rows to every batch, going round its rows.

    rows: cls, ord (dense from 0 in each class) and more. Classes that are asked for but have no rows give none.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(shares.items()), "cls string, take int").where("take > 0")
    totals = rows.groupBy("cls").agg(F.count("*").alias("total"))
    slots = spark.range(0, batches).select(F.col("id").alias("batch")).join(F.broadcast(wanted))  # a row a class
    slots = slots.join(F.broadcast(totals), "cls").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("take") - 1)))
    slots = slots.select("batch", "cls", "k", F.pmod(F.col("batch") * F.col("take") + F.col("k"), F.col("total")).alias("ord"))
    return slots.join(rows, ["cls", "ord"])


def missing_classes(rows: DataFrame, shares: dict[str, int]) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([(c,) for c, n in sorted(shares.items()) if n > 0], "cls string")
    return wanted.join(rows.select("cls").distinct(), "cls", "left_anti")


#: Buckets of a number's range in which rows are put in order.
ORDER_BUCKETS = 4096


def dense_order(rows: DataFrame, group: str, by: str) -> DataFrame:
    """Add ord, the place from 0 in order of a number within each group."""
    ends = rows.agg(F.min(by).cast("double").alias("__low"), F.max(by).cast("double").alias("__high"))
    spread = rows.join(F.broadcast(ends))  # one row
    bucket = F.floor((F.col(by).cast("double") - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1.0)) * ORDER_BUCKETS)
    return numbered(spread, "ord", bucket, [by], (group,)).drop("__low", "__high").withColumn("ord", F.col("ord").cast("long"))


def mixed_radix(spark: SparkSession, n: int, sizes: list[int]) -> DataFrame:
    """i, d0, d1, …: the digits of i in the cycle of the product of the sizes, the last one running fastest."""
    digits, step = [], math.prod(sizes)
    for j, size in enumerate(sizes):
        step //= size
        digits.append(F.pmod(F.floor(F.col("id") / step), F.lit(size)).cast("int").alias(f"d{j}"))
    return spark.range(0, n).select(F.col("id").alias("i"), *digits)


def mixup_partners(rows: DataFrame, key: str, group: str, purpose: str = "mixup") -> DataFrame:
    """group, key, partner: rows of a batch in order of id are paired with the batch in hashed order."""
    plain = dense_order(rows.select(group, key), group, key).withColumnRenamed("ord", "rank")
    drawn = ranked(rows.select(group, key), key, purpose, group).select(group, F.col(key).alias("partner"), "rank")
    return plain.join(drawn, [group, "rank"]).select(group, key, "partner")


def beta(key: Column, purpose: str, alpha: float) -> Column:
    """A draw from Beta(alpha, alpha) by Johnk's rule: the first of eight hashed pairs that falls within the unit sum."""

    def pair(i: int) -> Column:
        return F.struct(F.pow(share(key, f"{purpose} {i} x"), F.lit(1 / alpha)).alias("x"), F.pow(share(key, f"{purpose} {i} y"), F.lit(1 / alpha)).alias("y"))

    fitting = F.filter(F.array(*(pair(i) for i in range(8))), lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0))
    return F.coalesce(F.get(F.transform(fitting, lambda p: p["x"] / (p["x"] + p["y"])), F.lit(0)), F.lit(0.5))


def mixup(rows: DataFrame, key: str, group: str, column: str, label: str, alpha: float, eligible: Column | None = None) -> DataFrame:
    """Rows blended with their partner of the same batch, features and labels alike, by a Beta draw a batch.

    Rows that are not eligible stay as they are and are nobody's partner.
    """
    able = rows if eligible is None else rows.where(eligible)
    pairs = mixup_partners(able, key, group)
    other = able.select(F.col(group), F.col(key).alias("partner"), F.col(column).alias("__x"), F.col(label).alias("__y"))
    met = rows.join(pairs, [group, key], "left").join(other, [group, "partner"], "left")
    t = F.when(F.col("partner").isNull(), F.lit(1.0)).otherwise(beta(F.col(group), "beta", alpha))
    drawn = met.withColumn("__t", t)
    blend = F.when(F.col("partner").isNull(), F.col(column)).otherwise(F.zip_with(column, "__x", lambda a, b: a * F.col("__t") + b * (1 - F.col("__t"))))
    mixed = F.when(F.col("partner").isNull(), F.col(label)).otherwise(F.col(label) * F.col("__t") + F.col("__y") * (1 - F.col("__t")))
    return drawn.withColumns({column: blend, label: mixed}).select(*rows.columns)


def cycled_settings(spark: SparkSession, n: int, batch: int, sizes: list[int]) -> DataFrame:
    """clip_idx, batch_no, d0, d1, …: a product of settings that goes on by one a batch, the last running fastest."""
    digits = mixed_radix(spark, -(-n // batch), sizes).withColumnRenamed("i", "batch_no")
    return spark.range(0, n).select(F.col("id").alias("clip_idx"), F.floor(F.col("id") / batch).alias("batch_no")).join(digits, "batch_no")


def voices_within(voices: DataFrame, count: int) -> DataFrame:
    """Voices from 0 below `count`; raises where none is left."""
    kept = voices.where((F.col("voice") >= 0) & (F.col("voice") < count))
    if kept.isEmpty():
        raise ValueError(f"no voice within {count}")
    return kept


def first_of(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first n rows in order of a text, such as a path: a limit that each task applies first."""
    return rows.orderBy(by).limit(n)


def consecutive_pairs(rows: DataFrame, key: str, column: str, *groups: str) -> DataFrame:
    """groups, pair, left, right: rows 2j and 2j + 1 of a group; a last single row has no pair."""
    paired = rows.withColumn("pair", F.floor(F.col(key) / 2))
    sides = paired.groupBy(*groups, "pair").agg(*(F.max(F.when(F.pmod(F.col(key), F.lit(2)) == i, F.col(column))).alias(n) for i, n in enumerate(("left", "right"))), F.count("*").alias("n"))
    return sides.where("n = 2").drop("n")


def speaker_pairs(clips: DataFrame, speakers: int) -> DataFrame:
    """Add a, b: two speakers drawn for each clip_idx, the second other than the first."""
    a = F.floor(share(F.col("clip_idx"), "speaker a") * speakers).cast("int")
    step = F.floor(share(F.col("clip_idx"), "speaker b") * (speakers - 1)).cast("int") + 1
    return clips.withColumn("a", a).withColumn("b", F.when(F.lit(speakers > 1), F.pmod(F.col("a") + step, F.lit(speakers))).otherwise(F.col("a")))


def pick(rows: DataFrame, key: str, dimension: DataFrame, purpose: str) -> DataFrame:
    """Join one row of `dimension` (ord dense from 0) to every row, by hash."""
    total = dimension.agg(F.count("*").alias("__total"))
    drawn = rows.join(F.broadcast(total)).withColumn("ord", F.floor(share(F.col(key), purpose) * F.col("__total")).cast("long")).drop("__total")
    return drawn.join(dimension, "ord").drop("ord")


def background_clips(spark: SparkSession, n: int, sources: DataFrame, samples: int, seed: int = 7) -> DataFrame:
    """clip_idx, ord, samples of n clips drawn from sources (ord dense from 0, samples).

    A source that is long enough gives a stretch at a drawn offset; a shorter one is laid end to end in turns
    from drawn starts, half of them backwards, and gives a stretch of that.
    """
    clips = pick(spark.range(0, n).select(F.col("id").alias("clip_idx")), "clip_idx", sources.where(F.size("samples") > 0).select("ord", F.col("samples").cast("array<double>").alias("source"), F.col("ord").alias("source_ord")), "background")
    size = F.size("source")
    turns = F.when(size < samples, F.ceil(F.lit(samples) / size)).otherwise(F.lit(0)).cast("int")
    key = lambda what, i: share(F.concat(F.col("clip_idx").cast("string"), F.lit("/"), i.cast("string")), what, seed)
    numbers = F.when(turns > 0, F.sequence(F.lit(1), turns)).otherwise(F.array().cast("array<int>"))
    starts = F.transform(numbers, lambda i: F.floor(key("turn", i) * size).cast("int"))
    back = F.transform(numbers, lambda i: key("backwards", i) < 0.5)
    laid = clips.withColumn("starts", starts).withColumn("back", back)
    laid = laid.withColumn("long", F.when(size < samples, signal.segments(F.col("source"), F.col("starts"), F.col("back"), 1 << 30)).otherwise(F.col("source")))
    offset = F.floor(share(F.col("clip_idx"), "offset", seed) * (F.size("long") - samples + 1)).cast("int")
    return laid.select("clip_idx", F.col("source_ord").alias("ord"), F.slice("long", offset + 1, F.lit(samples)).alias("samples"))


def learning_rate(step: Column, total: int, warmup: int, hold: int, peak: float) -> Column:
    """Linear rise, a level stretch, then a cosine fall to 0."""
    left = F.lit(float(max(1, total - warmup - hold)))
    fall = F.least(F.lit(1.0), (step - warmup - hold) / left)
    return F.when(step < warmup, F.lit(peak) * step / float(max(1, warmup))).when(step < warmup + hold, F.lit(peak)).otherwise(F.lit(peak) * 0.5 * (1 + F.cos(F.lit(math.pi) * fall)))


def ramp(step: Column, total: int, first: float, last: float) -> Column:
    """From `first` at step 0 towards `last`, which step `total` would have."""
    return F.lit(first) + F.lit(last - first) * step / float(max(1, total))


def plan_missing(planned: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """What is planned and not there yet: resumes by key, so gaps are filled and nothing is done twice."""
    return planned.join(present.select(*keys).distinct(), list(keys), "left_anti")
