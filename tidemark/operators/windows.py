"""Ordered-stream operators: windows, runs, debounced detections, gates, layouts.

All are keyed by stream_id and ordered by hop, and no stream is one task's work. Hops of a stream are dense:
one row a hop. What looks back over a few rows is computed slice by slice of SLICE hops, each slice with the
rows before it that it needs. What runs along a whole stream is computed in two steps, within the slices and
then over one row a slice. Detections are folded per slice for every state that can come in from before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import passes
from tidemark.sources.tables import HOP_SECONDS, WINDOW_STEPS


#: Hops of a slice of a stream.
SLICE = 4096


def sliced(rows: DataFrame, back: int, hops: int | None = None) -> DataFrame:
    """Add __slice and __own: each row in its slice and, not its own, in the next one where that looks back at it."""
    n = hops or max(SLICE, back + 1)
    own = F.floor(F.col("hop") / n)
    if back <= 0:
        return rows.withColumn("__slice", own).withColumn("__own", F.lit(True))
    seen = F.when(F.pmod(F.col("hop"), F.lit(n)) >= n - back, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("__slice", F.explode(seen)).withColumn("__own", F.col("__slice") == own)


def by_slice() -> Window:
    return Window.partitionBy("stream_id", "__slice").orderBy("hop")


def stride_windows(stream: DataFrame, column: str, steps: int = WINDOW_STEPS) -> DataFrame:
    """stream_id, hop (of the last row), window: all full windows of `steps` rows."""
    frame = by_slice().rowsBetween(-(steps - 1), 0)
    cut = sliced(stream.select("stream_id", "hop", F.col(column).alias("__x")), steps - 1)
    return cut.withColumn("window", F.collect_list("__x").over(frame)).where(F.col("__own") & (F.size("window") == steps)).select("stream_id", "hop", "window")


def last_padded(sequence: Column, steps: int, zero: Column) -> Column:
    """The last `steps` entries, with zeros on the left where there are fewer."""
    short = F.concat(F.array_repeat(zero, F.greatest(F.lit(0), F.lit(steps) - F.size(sequence))), sequence)
    return F.slice(short, F.size(short) - steps + 1, F.lit(steps))


def reblock(stream: DataFrame, column: str, steps: int = WINDOW_STEPS) -> DataFrame:
    """Contiguous blocks of `steps` rows; the rest of a stream is dropped."""
    block = F.floor(F.col("hop") / steps).alias("block")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("hop", F.col(column).alias("x")))), lambda r: r["x"])
    return stream.groupBy("stream_id", block).agg(rows.alias("rows")).where(F.size("rows") == steps)


def run_fires(hops: DataFrame, threshold: float, k: int) -> DataFrame:
    """Hops at which the last k scores all reach the threshold."""
    frame = by_slice().rowsBetween(-(k - 1), 0)
    above = passes(F.col("score"), threshold).cast("int")
    marked = sliced(hops, k - 1).withColumn("__low", F.min(above).over(frame)).withColumn("__seen", F.count(F.lit(1)).over(frame))
    return marked.where(f"__own and __low = 1 and __seen = {k}").drop("__low", "__seen", "__slice", "__own")


def lowest_of_last(hops: DataFrame, k: int) -> DataFrame:
    """stream_id, hop, score: the least of the last k scores, NaN and null as the lowest; hops with fewer before them are left out."""
    frame = by_slice().rowsBetween(-(k - 1), 0)
    score = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    cut = sliced(hops.select("stream_id", "hop", score.alias("score")), k - 1)
    marked = cut.withColumn("__low", F.min("score").over(frame)).withColumn("__seen", F.count(F.lit(1)).over(frame))
    return marked.where(f"__own and __seen = {k}").select("stream_id", "hop", F.col("__low").alias("score"))


def run_lengths(hops: DataFrame, threshold: float) -> DataFrame:
    """Add run: how many scores in a row up to this hop reach the threshold."""
    low = F.when(~passes(F.col("score"), threshold), F.col("hop"))
    cut = sliced(hops, 0)
    upto = by_slice().rowsBetween(Window.unboundedPreceding, 0)
    # the last low hop before a slice: one row a slice
    before = Window.partitionBy("stream_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("stream_id", "__slice").agg(F.max(low).alias("__last"), F.min("hop").alias("__first"))
    carried = ends.select("stream_id", "__slice", F.coalesce(F.max("__last").over(before), F.coalesce(F.min("__first").over(before), F.col("__first")) - 1).alias("__carry"))
    marked = cut.withColumn("__low", F.max(low).over(upto)).join(carried, ["stream_id", "__slice"])
    return marked.withColumn("run", F.col("hop") - F.coalesce("__low", "__carry")).drop("__low", "__carry", "__slice", "__own")


def debounced(candidates: DataFrame, skip: int, keys: tuple[str, ...] = ("stream_id",), hops: int = SLICE) -> DataFrame:
    """keys, hop of the candidates that fire: after a fire the next may come `skip` hops later.

    Each slice of a stream is folded by itself, for every number of hops that can have passed since the last
    fire before it; a row a slice then tells what really had, and the slice's fires follow. So a stream that
    is above the threshold all the time is no longer row than any other.
    """
    n = max(hops, skip)
    cut = candidates.select(*keys, "hop", F.floor(F.col("hop") / n).alias("slice")).groupBy(*keys, "slice").agg(F.array_sort(F.collect_list("hop")).alias("hops"))
    # since: hops from the last fire to the slice's first hop; 0 where any hop may fire
    base, following = F.col("slice") * n, (F.col("slice") + 1) * n
    far = F.lit(-(2**62)).cast("bigint")
    since = lambda last: F.when(following - last >= skip, F.lit(0).cast("bigint")).otherwise(following - last)

    def left(entry: Column) -> Column:
        start = F.when(entry == 0, far).otherwise(base - entry)
        return since(F.aggregate("hops", start, lambda last, hop: F.when(hop - last >= skip, hop).otherwise(last)))

    # from a candidate on that follows the one before by `skip` hops, what came in no longer matters
    fresh = F.exists(F.sequence(F.lit(1), F.size("hops")), lambda i: F.element_at("hops", i.cast("int")) - F.coalesce(F.try_element_at("hops", F.when(i > 1, i - 1).otherwise(F.lit(2**30)).cast("int")), base) >= skip)
    entries = F.sequence(F.lit(0).cast("bigint"), F.lit(skip - 1).cast("bigint"))
    states = cut.withColumn("exits", F.when(fresh, F.array(left(F.lit(0)))).otherwise(F.transform(entries, left)))
    along = F.array_sort(F.collect_list(F.struct("slice", "exits")))
    begin = F.struct(F.lit(-1).cast("bigint").alias("slice"), F.lit(0).cast("bigint").alias("since"), F.array().cast("array<struct<slice:bigint,entry:bigint>>").alias("done"))

    def step(state: Column, s: Column) -> Column:
        entry = F.when(s["slice"] == state["slice"] + 1, state["since"]).otherwise(F.lit(0).cast("bigint"))
        leaving = F.element_at(s["exits"], F.least(F.size(s["exits"]).cast("bigint"), entry + 1).cast("int"))
        noted = F.when(entry > 0, F.array_append(state["done"], F.struct(s["slice"].alias("slice"), entry.alias("entry")))).otherwise(state["done"])
        return F.struct(s["slice"].alias("slice"), leaving.alias("since"), noted.alias("done"))

    known = states.groupBy(*keys).agg(F.aggregate(along, begin, step, lambda x: x["done"]).alias("done"))
    entered = known.select(*keys, F.explode("done").alias("e")).select(*keys, F.col("e.slice").alias("slice"), F.col("e.entry").alias("entry"))
    full = cut.join(entered, [*keys, "slice"], "left").withColumn("last", F.when(F.col("entry") > 0, base - F.col("entry")).otherwise(far))
    return full.select(*keys, F.explode(_fold("hops", "last", skip)).alias("hop"))


def _fold(column: str, last: str, skip: int) -> Column:
    """Greedy choice over a sorted array, with the last fire beside the list."""
    start = F.struct(F.col(last).alias("last"), F.array().cast("array<bigint>").alias("done"))

    def step(state: Column, hop: Column) -> Column:
        fires = hop - state["last"] >= skip
        return F.when(fires, F.struct(hop.alias("last"), F.array_append(state["done"], hop).alias("done"))).otherwise(state)

    return F.aggregate(column, start, step, lambda s: s["done"])


def detections(hops: DataFrame, threshold: float, skip: int, k: int = 1) -> DataFrame:
    """stream_id, hop of debounced detections, each the k-th of a run of scores at the threshold or above."""
    candidates = run_fires(hops, threshold, k) if k > 1 else hops.where(passes(F.col("score"), threshold))
    return debounced(candidates.select("stream_id", "hop"), skip)


def debounce_hops(seconds: float) -> int:
    """Seconds to hops, rounded half to even, one at least."""
    return max(1, round(seconds / HOP_SECONDS))


def rolling_gate(frames: DataFrame, flag: str, frames_in_window: int, needed: int) -> DataFrame:
    """Add gate_open: at least `needed` flags among the last frames."""
    frame = by_slice().rowsBetween(-(frames_in_window - 1), 0)
    marked = sliced(frames, frames_in_window - 1).withColumn("gate_open", F.sum(F.col(flag).cast("int")).over(frame) >= needed)
    return marked.where("__own").drop("__slice", "__own")


def gated(score: Column, is_open: Column) -> Column:
    return F.when(is_open, score).otherwise(F.lit(0.0))


def layout(clips: DataFrame, lead: int, gap: int) -> DataFrame:
    """Add start, stop: clips of `length` one after another with gaps, by prefix sums over `hop`."""
    cut = sliced(clips, 0)
    size = F.col("length") + gap
    inside = F.coalesce(F.sum(size).over(by_slice().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy("stream_id", "__slice").agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy("stream_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = sums.select("stream_id", "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carry"))
    placed = cut.withColumn("__inside", inside).join(carried, ["stream_id", "__slice"]).withColumn("start", F.lit(lead) + F.col("__carry") + F.col("__inside"))
    return placed.withColumn("stop", F.col("start") + F.col("length")).drop("__inside", "__carry", "__slice", "__own")


def edge_trim(frames: DataFrame, flag: str, pad: int) -> DataFrame:
    """Frames from `pad` before the first flagged to `pad` after the last; a stream without flags is kept whole."""
    ends = frames.where(F.col(flag)).groupBy("stream_id").agg(F.min("hop").alias("__first"), F.max("hop").alias("__last"))
    marked = frames.join(ends, "stream_id", "left")
    return marked.where(f"__first is null or hop between __first - {pad} and __last + {pad}").select(*frames.columns)


def max_pool(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.max("score").alias("score"))
