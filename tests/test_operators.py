"""Hand-computed values of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dsp, signal
from tidemark.operators import matching, metrics, phrases, sampling, windows
from tidemark.sources import tables


def scored(spark, positive, negative, near=()):
    rows = [("positive", s) for s in positive] + [("background", s) for s in negative] + [("near_miss", s) for s in near]
    return spark.createDataFrame([(k, None if s is None else float(s)) for k, s in rows], "kind string, score double")


def hops(spark, spikes, n=60, stream=1):
    return spark.createDataFrame([(stream, i, 0.9 if i in spikes else 0.0) for i in range(n)], "stream_id long, hop long, score double")


def test_rates(spark):
    m = metrics.clip_metrics(scored(spark, [0.9, 0.8, 0.3], [0.1, 0.2, 0.6])).first()
    assert m.accuracy == pytest.approx(4 / 6) and m.recall == pytest.approx(2 / 3)
    m = metrics.clip_metrics(scored(spark, [0.9, 0.8, 0.3, 0.95, float("nan"), None], [])).first()
    assert m.recall == 0.5 and math.isinf(m.fpph) and m.negatives == 0


def test_sweep_is_the_naive_count(spark):
    values = [i / 97 for i in range(98)] + [0.57, 0.29, 1.0, 0.0, -0.5, 1.5, float("nan")]
    got = {r.step: r for r in metrics.sweep(scored(spark, values, values[::2]), hours=1.0).collect()}
    for step in range(1, 100):
        t = step / 100
        assert got[step].recall == pytest.approx(sum(v >= t for v in values) / len(values))
        assert got[step].fpph == sum(v >= t for v in values[::2])


def test_best_thresholds_take_the_lowest_of_equals(spark):
    swept = spark.createDataFrame([(i, i / 100, r, 0.0, f, a) for i, r, f, a in [(10, 0.9, 5.0, 0.6), (20, 0.9, 1.0, 0.7), (30, 0.9, 0.5, 0.8), (50, 0.4, 0.0, 0.9)]], "step int, threshold double, recall double, fpr double, fpph double, accuracy double")
    got = {r.target: (r.tier, r.threshold) for r in metrics.best_thresholds(swept, [1.0, 0.1]).collect()}
    assert got == {1.0: (1, 0.2), 0.1: (2, 0.3)}
    low = swept.where("step = 50").unionByName(swept.where("step = 10").withColumn("recall", F.lit(0.1)))
    assert [(r.tier, r.threshold) for r in metrics.best_thresholds(low, [1.0]).collect()] == [(3, 0.5)]


def test_area_and_recall_threshold(spark):
    perfect = metrics.area_under_det(metrics.det_curve(scored(spark, [1.0] * 5, [0.0] * 5))).first().aut
    assert perfect < 0.01
    s = scored(spark, [i / 100 for i in range(1, 101)], [], [0.1, 0.5, 0.95])
    got = {r.target: (r.threshold, r.near_miss_accept) for r in metrics.recall_threshold(s, [0.9, 1.0]).collect()}
    assert got[0.9] == (0.11, pytest.approx(2 / 3)) and got[1.0][0] == 0.01


@pytest.mark.parametrize("spikes, skip, k, want", [([10, 11, 12, 30, 40], 25, 1, [10, 40]), ([2, 3], 1, 1, [2, 3]), ([5, 20, 21, 22], 25, 3, [22]), ([0, 20, 40], 25, 1, [0, 40]), ([], 5, 1, [])])
def test_debounce(spark, spikes, skip, k, want):
    assert sorted(r.hop for r in windows.detections(hops(spark, spikes), 0.5, skip, k).collect()) == want


def test_windows(spark):
    s = spark.range(0, 40).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("hop"), F.col("id").cast("double").alias("x"))
    got = sorted((r.hop, r.window) for r in windows.stride_windows(s, "x").collect())
    assert len(got) == 25 and got[7][1] == [float(i) for i in range(7, 23)]
    assert windows.stride_windows(s.where("hop < 5"), "x").count() == 0
    assert [len(r.rows) for r in windows.reblock(s, "x").collect()] == [16, 16]
    assert windows.debounce_hops(0.1) == 1 and windows.debounce_hops(0.2) == 2 and windows.debounce_hops(2.0) == 25
    padded = s.limit(1).select(windows.last_padded(F.array(F.lit(1.0), F.lit(2.0)), 4, F.lit(0.0)).alias("p")).first().p
    assert padded == [0.0, 0.0, 1.0, 2.0]


def test_gate_layout_trim(spark):
    f = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, False, True, True, False, False])], "stream_id long, hop long, b boolean")
    assert [r.gate_open for r in windows.rolling_gate(f, "b", 3, 2).orderBy("hop").collect()] == [False, False, True, True, True, False]
    assert sorted(r.hop for r in windows.edge_trim(f, "b", 1).collect()) == [0, 1, 2, 3, 4]
    assert windows.edge_trim(f.withColumn("b", F.lit(False)), "b", 1).count() == 6
    c = spark.createDataFrame([(1, 0, 16_000), (1, 1, 8_000)], "stream_id long, hop long, length int")
    assert [r.start for r in windows.layout(c, 32_000, 48_000).orderBy("hop").collect()] == [32_000, 96_000]


def test_interval_hits_across_slices(spark):
    fires = spark.createDataFrame([(1, 255), (1, 256), (1, 600), (2, 5)], "stream_id long, hop long")
    spans = spark.createDataFrame([(1, 7, 250, 255), (1, 8, 255, 520), (1, 9, 601, 602), (3, 1, 0, 9)], "stream_id long, clip_no long, start long, end long")
    got = {r.clip_no: r.hits for r in matching.interval_hits(fires, spans, 1).collect()}
    assert got == {7: 2, 8: 2, 9: 0, 1: 0}


def test_summary_of_false_accepts(spark):
    h = hops(spark, [3, 50])
    spans = spark.createDataFrame([(1, 1, 2, 4), (1, 2, 20, 22)], "stream_id long, clip_no long, start long, end long")

    def summary(kind, hours):
        streams = spark.createDataFrame([(1, kind, hours)], "stream_id long, kind string, hours double")
        return {r.stream_id: r for r in matching.stream_summary(windows.detections(h, 0.5, 5), spans, streams).collect()}

    out = summary("positive", 1.0)
    assert (out[1].clips, out[1].misses, out[1].fires, out[1].false_accepts) == (2, 1, 2, 1) and out[None].clips == 2 and out[1].fa_per_hour is None
    out = summary("background", 2 / 3600)  # one of two clips fires; every fire counts
    assert (out[1].misses, out[1].false_accepts, out[1].fa_per_clip, out[1].fa_per_hour) == (None, 2, 0.5, 2 / (2 / 3600))
    assert summary("background", 0.0)[1].fa_per_hour == 0.0 and summary("near_miss", 1.0)[1].fa_per_hour is None


def test_selection_takes_the_highest_of_equals(spark):
    det = spark.createDataFrame([(1, 0.1, 9.0), (2, 0.1, 1.0), (3, 0.1, 0.5), (4, 0.3, 0.0)], "step int, miss_rate double, fa_per_hour double")
    assert matching.select_point(det, 1.0).first().step == 3
    assert matching.select_point(det.where("step < 4"), 0.1).first().step == 3


def test_phrases(spark):
    one = spark.createDataFrame([("cat",), ("a",), ("",)], "word string")
    two = spark.createDataFrame([("cut",), ("cat",), ("cart",), ("dog",), ("at",), ("tac",)], "word string")
    assert sorted((r.word, r.neighbour) for r in phrases.neighbours(one, two).collect()) == [("a", "at"), ("cat", "at"), ("cat", "cart"), ("cat", "cut")]
    row = spark.range(1).select(phrases.leave_one_out(phrases.words(F.lit(" Hey, my Computer! "))).alias("p"), phrases.words(F.lit("")).alias("e")).first()
    assert row.p == ["my computer", "hey computer", "hey my"] and row.e == []
    swapped = phrases.swaps(spark.createDataFrame([("hey zuck",)], "phrase string"), spark.createDataFrame([("hey", "there"), ("zuck", "siri")], "word string, neighbour string"))
    assert sorted(r.variant for r in swapped.collect()) == ["hey siri", "there zuck"]
    known = spark.createDataFrame([("key",), ("board",), ("ke",), ("yboard",)], "word string")
    assert [tuple(r) for r in phrases.known_cut(spark.createDataFrame([("keyboard",), ("x",)], "word string"), known).collect()] == [("keyboard", "key", "board")]
    symbols = F.array(F.lit("Z"), F.lit("AH"), F.lit("K"), F.lit("D"))
    d = phrases.token_distance(F.array(F.lit("Z"), F.lit("AH"), F.lit("K")), F.array(F.lit("D"), F.lit("AH"), F.lit("K")), symbols, 1)
    assert spark.range(1).select(d.alias("d")).first().d == 1


def test_holdout_and_schedule(spark):
    items = spark.createDataFrame([(f"p{i}",) for i in range(50)], "p string")
    sides = phrases.holdout(items, "p", 0.2).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in sides} == {"train": 40, "test": 10}
    assert sorted(r.side for r in phrases.holdout(items.limit(1), "p", 0.2).collect()) == ["test", "train"]
    groups = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0)], "grp string, share double")
    listed = spark.createDataFrame([("a", f"a{i}") for i in range(4)] + [("b", "b0")], "grp string, phrase string")
    dealt = phrases.schedule(groups, listed, 1000).groupBy("phrase").count().collect()
    assert {r.phrase: r["count"] for r in dealt} == {"a0": 175, "a1": 175, "a2": 175, "a3": 175, "b0": 300}


def test_sampling(spark):
    rows = spark.createDataFrame([("x", i) for i in range(4)] + [("y", 0)], "cls string, ord long")
    got = sampling.cyclic_batches(rows, {"x": 3, "y": 2, "z": 1}, 2).orderBy("batch", "cls", "k").collect()
    assert [r.ord for r in got] == [0, 1, 2, 0, 0, 3, 0, 1, 0, 0]
    assert [r.cls for r in sampling.missing_classes(rows, {"x": 1, "z": 1}).collect()] == ["z"]
    digits = [tuple(r)[1:] for r in sampling.mixed_radix(spark, 61, [3, 2, 3]).orderBy("i").collect()]
    assert digits == [(i // 6 % 3, i // 3 % 2, i % 3) for i in range(61)]
    assert sampling.sample(rows, "ord", 2, "cls").count() == 3
    done = spark.createDataFrame([(1,), (3,)], "i long")
    assert sorted(r.i for r in sampling.plan_missing(spark.range(5).withColumnRenamed("id", "i"), done, "i").collect()) == [0, 2, 4]


def test_signals(spark):
    x = F.array(*(F.lit(float(v)) for v in (1, 2, 3)))
    row = spark.range(1).select(
        signal.tiled(x, F.lit(1), F.lit(5)).alias("tiled"), signal.end_aligned(x, 5, F.lit(1)).alias("end"), signal.end_aligned(x, 2, F.lit(1)).alias("cut"),
        signal.centred(x, 6).alias("centre"), signal.joined(x, F.lit(1), x).alias("pair"), signal.frames(x, 2).alias("frames"), signal.snr_gain(x, x, F.lit(20.0)).alias("gain"),
        signal.to_int16(F.array(F.lit(2.0), F.lit(-0.5))).alias("short"), signal.slerp(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.lit(0.5)).alias("slerp"),
    ).first()
    assert row.tiled == [2.0, 3.0, 1.0, 2.0, 3.0] and row.end == [0.0, 1.0, 2.0, 3.0, 0.0] and row.cut == [2.0, 3.0]
    assert row.centre == [0.0, 1.0, 2.0, 3.0, 0.0, 0.0] and row.pair == [1.0, 2.0, 3.0, 0.0, 1.0, 2.0, 3.0] and row.frames == [[1.0, 2.0], [3.0, 0.0]]
    assert row.gain == pytest.approx(0.1) and row.short == [32767, -16383] and row.slerp == pytest.approx([2**-0.5] * 2)


def test_dsp():
    import numpy as np

    x = np.sin(np.arange(16_000) * 2 * np.pi * 440 / 16_000)
    assert len(dsp.mel(x)) == (16_000 - 512) // 160 + 1 and len(dsp.mel(x)[0]) == 32 and len(dsp.mel(x[:100])) == 0
    assert np.allclose(dsp.convolve(x, np.array([0.5, 0.0])), x) and len(dsp.resample(x, 16_000, 8_000)) == 8_000
    assert np.allclose(dsp.equalise(x, [0.0, 0.0]), x) and np.abs(dsp.distort(x, 3.0)).max() == pytest.approx(np.abs(x).max())


def test_hash_share(spark):
    got = [r.s for r in spark.range(1000).select(tables.share(F.col("id"), "x").alias("s")).collect()]
    assert 0 <= min(got) and max(got) < 1 and 0.45 < sum(got) / 1000 < 0.55
