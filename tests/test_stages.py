import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import synthesis
from tidemark.plans import stages
from tidemark.plans.config import Config, Size, build, load_config
from tidemark.sources.dictionary import spelled_dictionary
from tidemark.streaming.scorer import Geometry, Model


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("phrases: [hey test]\nsize: tiny\naugmentation: {rounds: 2}\nbatch: {positive: 1, odd: 2}\n")
    with pytest.warns(UserWarning, match="odd"):
        c = load_config(str(tmp_path / "c.yaml"))
    assert c.size is Size.tiny and c.augmentation.rounds == 2
    for bad in ({"phrases": []}, {"phrases": ["a"], "holdout": 2}, {"phrases": ["a"], "shares": {"x": 0.7, "y": 0.4}}, {"phrases": ["a"], "nope": 1}, {"phrases": ["a"], "streaming": {"gap_seconds": 0.01}}):
        with pytest.raises(ValueError):
            build(Config, bad).check()


def test_phrases_to_plan(spark):
    words = spark.createDataFrame([(w,) for w in ("haystack", "theystack", "text", "best", "haystick", "test", "heystack", "unrelated", "siri")], "word string")
    dictionary = spelled_dictionary(words)
    c = Config(phrases=["Haystack test"], custom_negatives=["play test"], custom_share=0.2, swap_share=0.3, n_train=40, n_test=10, holdout=0.4).check()
    planned = stages.generate_phrases(c, spark, dictionary, swap_words=spark.createDataFrame([("siri",), ("unrelated",)], "word string"))
    by = {(r.phrase, r.side): r.kind for r in planned.collect()}
    assert by["haystack test", "train"] == by["haystack test", "test"] == "target" and by["play test", "test"] == by["play test", "train"] == "custom"
    kinds = {p: k for (p, _), k in by.items()}
    assert kinds["haystack best"] == kinds["haystack"] == kinds["test"] == "near_miss" and kinds["siri test"] == "swap"
    assert "heystack test" not in kinds or kinds["heystack test"] == "near_miss"
    sides = [s for (p, s), k in by.items() if k in ("near_miss", "swap")]
    assert len(sides) == len({p for (p, s), k in by.items() if k in ("near_miss", "swap")}) and set(sides) == {"train", "test"}
    plan = stages.generate_plan(c, planned)
    assert {r.split: r["count"] for r in plan.groupBy("split").count().collect()} == {"positive_train": 40, "positive_test": 10, "negative_train": 40, "negative_test": 10}
    groups = {(r.split, r.grp): r["count"] for r in plan.groupBy("split", "grp").count().collect()}
    assert groups["negative_train", "custom"] == 8 and groups["negative_train", "swap"] == 12 and groups["negative_train", "near_miss"] == 20
    bare = stages.generate_plan(Config(phrases=["a b"], custom_share=1.0, n_train=4, n_test=2), planned.where("kind <> 'custom'"))
    assert bare.where("split = 'negative_train' and grp = 'any'").count() == 4


def test_generate_resumes_and_tells_failures(spark):
    plan = spark.createDataFrame([("train", i, p) for i, p in enumerate(["hey you", "hey there", "", "you"])], "split string, clip_idx long, phrase string")
    made = stages.run_generate(Config(phrases=["a"]), plan, synthesis.Tones)
    rows = {r.clip_idx: r for r in made.collect()}
    assert len(rows) == 4 and len(rows[0].samples) > 800 and rows[2].samples == [] and all(r.problem is None for r in rows.values())
    again = stages.run_generate(Config(phrases=["a"]), plan, synthesis.Tones, made.where("clip_idx <> 1"))
    assert [(r.clip_idx, r.samples) for r in again.collect()] == [(1, rows[1].samples)]
    tight = synthesis.synthesize(synthesis.plan_clips(plan, 10, [1.0]), lambda: Narrow(), 4)
    assert all(r.problem is None for r in tight.collect())
    some = synthesis.synthesize(synthesis.plan_clips(plan.coalesce(1), 10, [1.0]), lambda: Picky(), 1).collect()
    assert {r.clip_idx for r in some if r.problem} == {2} and all(r.samples is None for r in some if r.problem)
    many = spark.range(6).select(F.lit("s").alias("split"), F.col("id").alias("clip_idx"), F.lit("").alias("phrase")).coalesce(1)
    with pytest.raises(Exception, match="in a row failed"):
        synthesis.synthesize(synthesis.plan_clips(many, 10, [1.0]), lambda: Picky(), 1).collect()


class Narrow(synthesis.Tones):
    def batch(self, texts, settings):
        if len(texts) > 1:
            raise MemoryError
        return super().batch(texts, settings)


class Picky(synthesis.Tones):
    def batch(self, texts, settings):
        if "" in texts:
            raise ValueError("no text")
        return super().batch(texts, settings)


def test_alignment_and_masks():
    path = synthesis.alignment(np.array([2, 0, 3]))
    assert path.tolist() == [[1, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 1, 1, 1]]
    assert synthesis.mask(np.array([1, 3])).tolist() == [[1, 0, 0], [1, 1, 1]] and synthesis.mask(np.array([2]), 4).tolist() == [[1, 1, 0, 0]]


def test_augment_extract_resume(spark, tmp_path):
    c = Config(phrases=["a"])
    c.augmentation.rounds = 2
    wave = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: F.sin(i / 5.0))
    clips = spark.range(3).select(F.lit("train").alias("split"), F.col("id").alias("clip_idx"), wave.alias("samples"))
    noise = spark.range(2).select(F.col("id").alias("ord"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.cos(i * 1.7)).alias("samples"))
    out = stages.run_augment(c, clips, noise, noise, samples=16_000)
    rows = out.collect()
    assert len(rows) == 6 and all(len(r.samples) == 16_000 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, stages.run_augment(c, clips.repartition(2), noise, noise, samples=16_000).collect()))
    features = stages.run_extraction(out, None).collect()
    assert all(len(r.features) == 16 and len(r.features[0]) == 32 for r in features)
    stages.write_split(out.where("clip_idx < 2").select("split", "clip_idx", "round"), str(tmp_path / "t"), "split", "clip_idx", "round")
    stages.write_split(out.select("split", "clip_idx", "round"), str(tmp_path / "t"), "split", "clip_idx", "round")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_evaluations(spark):
    hops = spark.createDataFrame([(s, h, 0.9 if h in (10, 50) and s == 1 else 0.6 if h == 30 else 0.1) for s in (1, 2) for h in range(100)], "stream_id long, hop long, score double")
    spans = spark.createDataFrame([(1, 1, 9, 11), (1, 2, 49, 51)], "stream_id long, clip_no long, start long, end long")
    streams = spark.createDataFrame([(1, "positive", 0.01), (2, "background", 0.01)], "stream_id long, kind string, hours double")
    c = Config(phrases=["a"])
    got = stages.run_streaming_eval(c, hops, spans, streams)
    best = got["selected"].first()
    assert best.miss_rate == 0 and best.false_accepts == 0 and 60 < best.step <= 90
    shown = {r.set: r for r in got["report"].collect()}
    assert shown["1"].missed == "0.0 %" and shown["all background"]["an hour"] == "0.00" and shown["1"]["an hour"] == "-"
    with pytest.raises(ValueError):
        stages.run_streaming_eval(c, hops, spans, streams.where("kind <> 'positive'"))
    checked = hops.withColumn("second", F.when(F.col("hop") == 10, 0.1).otherwise(0.9)).withColumn("open", F.col("hop") != 50)
    closed = stages.run_streaming_eval(c, checked, spans, streams, "second", "open")
    assert closed["selected"].first().misses == 2
    scores = spark.createDataFrame([("positive", 0.9), ("background", 0.1)], "kind string, score double")
    assert stages.run_eval(scores, [0.5])["metrics"].first().recall == 1.0


def test_sets_and_clips(spark):
    default = spark.createDataFrame([("positive", "positive", "/a"), ("near", "near_miss", "/b")], "set string, kind string, path string")
    own = spark.createDataFrame([("near", "near_miss", "/own"), ("radio", "background", "/r")], "set string, kind string, path string")
    sets = stages.evaluation_sets(default, own)
    assert sorted((r.set, r.path) for r in sets.collect()) == [("near", "/own"), ("positive", "/a"), ("radio", "/r")]
    files = spark.createDataFrame([("near", f"/own/{i}") for i in range(9)] + [("positive", "/a/1")], "set string, path string")
    got = stages.clips_of_sets(sets, files, 4).collect()
    assert sorted((r.set, r.idx) for r in got) == [("near", 0), ("near", 1), ("near", 2), ("near", 3), ("positive", 0)]
    near = [r.path for r in sorted(got, key=lambda r: r.idx) if r.set == "near"]
    assert near == sorted(near)


def loudness() -> Model:
    """Frames are mean magnitudes, and so are stretches; a window scores its loudest."""
    return Model(lambda x: np.abs(np.lib.stride_tricks.sliding_window_view(x, 512)[::160]).mean(1)[:, None], lambda s: s.mean(1), lambda v: float(v.max()))


def test_streams_are_built_scored_and_judged(spark):
    """Loud and quiet clips in streams of their own, from layout to the summary."""
    rate, loud, quiet = 16_000, 0.5, 0.1
    clip = lambda level, n: F.array_repeat(F.lit(level), n)
    rows = [(1, "positive", 0, loud, rate), (1, "positive", 1, quiet, rate // 2), (2, "background", 0, loud, rate), (2, "background", 1, quiet, rate)]
    clips = spark.createDataFrame(rows, "stream_id long, kind string, idx long, level double, n int").withColumn("samples", F.expr("array_repeat(level, n)"))
    c = Config(phrases=["a"])
    chunks, spans, streams = stages.build_streams(clips, c)
    at = {(r.stream_id, r.clip_no): (r.start, r.end) for r in spans.collect()}
    assert at[1, 0] == (25, 37) and at[1, 1] == (75, 81)
    assert {r.stream_id: round(r.hours * 3600, 6) for r in streams.collect()} == {1: 1.5, 2: 2.0}
    scores = stages.score_streams(chunks, loudness, Geometry(depth=100.0))
    assert scores.where("hop < 24").agg(F.max("score")).first()[0] == 0 and scores.where("stream_id = 1").count() == (2 * rate + 1.5 * rate + 6 * rate) // 1280
    c.streaming.threshold, c.streaming.tail_hops = 0.3, 13
    out = {r.stream_id: r for r in stages.run_streaming_eval(c, scores, spans, streams)["summary"].collect()}
    assert (out[1].clips, out[1].misses, out[2].false_accepts, out[2].fa_per_clip) == (2, 1, 1, 0.5) and out[2].fa_per_hour == pytest.approx(1 / (2 / 3600))
    bed = spark.createDataFrame([(1,)], "stream_id long").withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.sin(i * 1.0)))
    under, _, _ = stages.build_streams(clips.where("idx = 0 and stream_id = 1"), c, bed)
    first = under.where("seq = 0").first().samples
    assert len(first) == 2 * rate and 10 * np.log10(loud**2 / np.mean(np.square(first))) == pytest.approx(c.streaming.snr_db, abs=0.5)
    again = {r.seq: r.samples for r in under.collect()}
    assert again[1][-1] == pytest.approx(again[0][(2 * rate + 4 * rate - 1) % 1000])  # one bed under the whole stream


def test_contexts_and_halves(spark):
    c = Config(phrases=["a"])
    c.augmentation.context_probability = c.augmentation.split_probability = 1.0
    wave = lambda f: F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.sin(i * f))
    clips = spark.range(4).select(F.col("id").alias("clip_idx"), wave(0.1).alias("samples"))
    talk = spark.range(2).select(F.col("id").alias("ord"), wave(0.3).alias("samples"))
    pairs = spark.range(1).select(F.col("id").alias("ord"), wave(0.2).alias("left"), wave(0.2).alias("right"))
    for split, longest in (("positive_train", 6000), ("negative_test", 3000)):
        rows = stages.with_contexts(c, clips, split, talk, talk.limit(0), pairs).collect()
        assert len(rows) == 4 and all(len(r.samples) == 32_000 for r in rows)
        assert all(np.abs(r.samples[: 32_000 - longest - 3200]).max() > 0.1 for r in rows)
    assert stages.placement(c, "negative_test")["split"] == 0 and stages.placement(c, "positive_test")["split"] == 1
    assert stages.with_contexts(c, clips, "negative_train", talk.limit(0), talk.limit(0), pairs.limit(0)).count() == 4
