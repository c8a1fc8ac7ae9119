"""Operators that no query or other test reaches alone."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dsp, signal
from tidemark.operators import metrics, phrases, sampling, scoring


def test_voices_settings_and_first_rows(spark):
    voices = spark.createDataFrame([(v,) for v in (-1, 0, 3, 9)], "voice int")
    assert sorted(r.voice for r in sampling.voices_within(voices, 4).collect()) == [0, 3]
    with pytest.raises(ValueError, match="no voice within 0"):
        sampling.voices_within(voices, 0)
    got = [(r.d0, r.d1, r.d2) for r in sampling.cycled_settings(spark, 100, 3, [2, 3, 2]).orderBy("clip_idx").collect()]
    product = itertools.cycle(itertools.product(range(2), range(3), range(2)))
    assert got == [s for s in itertools.islice(product, 34) for _ in range(3)][:100]
    paths = spark.createDataFrame([(f"/{i:03d}",) for i in range(50)], "path string").repartition(4)
    assert [r.path for r in sampling.first_of(paths, "path", 3).collect()] == ["/000", "/001", "/002"]


def test_mel_in_rows_is_numpy(spark):
    rng = np.random.default_rng(4)
    clips = [rng.normal(size=n) for n in (16_000, 2_000, 100)]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(clips)] + [(3, None)], "i int, samples array<double>")
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    bands = dsp.per_row(df, "samples", "bands", kind, dsp.mel)
    rows = {r.i: r for r in bands.select("i", "bands", signal.floored(F.col("bands"), 0.5).alias("low"), F.size(signal.mel_windows(F.col("bands"))).alias("n")).collect()}
    for i, c in enumerate(clips):
        want = dsp.mel(c)
        assert np.allclose(np.array(rows[i].bands).reshape(want.shape), want)
        if len(want):
            assert np.allclose(rows[i].low, np.maximum(want, want.max() - 0.5))
        assert rows[i].n == max(0, (len(want) - 76) // 8 + 1)
    assert rows[3].bands is None


def test_logistic_scorer_on_rows_it_has_not_seen(spark):
    rng = np.random.default_rng(6)
    rows = [((rng.normal(size=5) + (1.5 if y else -1.5)).tolist(), float(y), i % 4 == 0) for i, y in enumerate(rng.integers(0, 2, 200).tolist())]
    df = spark.createDataFrame(rows, "x array<double>, y double, held boolean")
    out = scoring.apply_logistic(scoring.train_hardening(df.where("not held"), "x", "y"), df.where("held"), "x").collect()
    assert len(out) == 50 and np.mean([(r.score >= 0.5) == (r.y > 0.5) for r in out]) >= 0.95
    centre = scoring.centroid(df.where("y > 0.5"), "x")
    want = np.mean([r[0] for r in rows if r[1] > 0.5], axis=0)
    assert np.allclose(centre.first().centroid, want)
    scored = scoring.centroid_scores(df, "x", centre).collect()
    assert all(r.score == pytest.approx(1 / (1 + np.exp(-np.dot(r.x, want)))) for r in scored)


def test_text_functions(spark):
    t = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert t(phrases.strip_stress(F.array(F.lit("AH0"), F.lit("K")))) == ["AH", "K"]
    assert [tuple(c) for c in t(phrases.clauses(F.lit("Hey, you! there")))] == [("Hey", ","), ("you", "!"), ("there", "")]
    assert t(phrases.pad_ids(F.array(F.lit(5), F.lit(6)), 0, F.lit(8))) == [0, 5, 0, 6, 0, 0, 0, 0]
    assert t(metrics.smoothed(F.lit(1.0), 0.2)) == pytest.approx(0.9) and t(metrics.negative_weight(F.lit(0.1), F.lit(4.0))) == 4.0
    nfd = phrases.decomposed(spark.createDataFrame([("é",), (None,)], "s string"), "s")
    assert sorted(len(r.s or "") for r in nfd.collect()) == [0, 2]
    cut = t(phrases.cut_at(F.array(*map(F.lit, "abcd")), F.lit("k")))
    assert sum(cut, []) == list("abcd") and all(cut) and t(phrases.cut_at(F.array(F.lit("a")), F.lit("k"))) is None


def test_context_goes_before_the_clip(spark):
    x, c = F.array(*[F.lit(1.0)] * 4), F.array(*[F.lit(2.0)] * 3)
    row = spark.range(1).select(
        signal.with_context(x, c, 12, F.lit(1), F.lit(2), F.lit(0.0)).alias("placed"), signal.with_context(x, c, 6, F.lit(0), F.lit(2), F.lit(0.0)).alias("none"),
        signal.with_context(x, F.array().cast("array<double>"), 6, F.lit(0), F.lit(0), F.lit(0.0)).alias("empty"),
    ).first()
    assert row.placed == pytest.approx([0, 0, 1, 1, 1, 0, 0, 1, 1, 1, 1, 0], abs=1e-6)  # at the clip's level
    assert row.none == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0] == row.empty
