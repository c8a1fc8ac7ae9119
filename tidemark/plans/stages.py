"""The offline pipeline as functions from DataFrames to DataFrames: phrases, augmentation, features, training, evaluation.

Stages hand over written tables. A stage that runs again does only what its manifest lacks, by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dsp, signal
from tidemark.operators import matching, metrics, phrases, sampling, scoring, synthesis, training, windows
from tidemark.plans.config import Config
from tidemark.sources import sinks
from tidemark.sources.tables import HOP_SAMPLES, HOP_SECONDS, SAMPLE_RATE, share
from tidemark.streaming import feeds
from tidemark.streaming.scorer import Geometry, score_audio


#: Hidden units of a head by model size.
HIDDEN = {"tiny": 0, "small": 16, "medium": 32, "large": 64}


def generate_phrases(config: Config, spark: SparkSession, dictionary: DataFrame, distance: int | None = None, swap_words: DataFrame | None = None) -> DataFrame:
    """phrase, kind, side: targets, custom negatives, near misses and, with a list of words, swaps.

    dictionary: word, phones. Near misses and swaps are held out to one side each, targets and custom phrases
    are on both. Negatives never repeat a target, near misses no custom phrase, swaps neither.
    """
    target = spark.createDataFrame([(p,) for p in config.phrases], "phrase string").select(F.array_join(phrases.words(F.col("phrase")), " ").alias("phrase")).distinct()
    plain = F.array_join(phrases.words(F.col("phrase")), " ").alias("phrase")
    custom = spark.createDataFrame([(p,) for p in config.custom_negatives], "phrase string").select(plain).distinct()
    near = phrases.adversarial_phrases(target, dictionary, config.partial_share, config.word_share, distance).select("phrase").join(custom, "phrase", "left_anti")
    near = sinks.written(near, "near_misses")
    negative = phrases.holdout(near.withColumn("kind", F.lit("near_miss")), "phrase", config.holdout)
    if swap_words is not None:
        swaps = phrases.word_swaps(target, swap_words, dictionary).select(F.col("variant").alias("phrase")).distinct().join(custom.unionByName(near), "phrase", "left_anti")
        negative = negative.unionByName(phrases.holdout(swaps.withColumn("kind", F.lit("swap")), "phrase", config.holdout, "swap holdout"))
    both = target.select("phrase", F.lit("target").alias("kind"), F.explode(F.array(F.lit("train"), F.lit("test"))).alias("side"))
    both = both.unionByName(custom.select("phrase", F.lit("custom").alias("kind"), F.explode(F.array(F.lit("train"), F.lit("test"))).alias("side")))
    return sinks.written(negative.unionByName(both), "phrases")


def generate_plan(config: Config, planned: DataFrame) -> DataFrame:
    """split, clip_idx, grp, phrase: the clips that each split needs, its groups in their shares.

    What swaps and custom phrases leave is the near misses' share. Where no group with a share has a phrase, all
    negative phrases are one group.
    """
    spark = planned.sparkSession
    shares = config.shares or {"swap": config.swap_share, "custom": config.custom_share, "near_miss": max(0.0, 1.0 - config.swap_share - config.custom_share)}
    if planned.where(F.col("kind").isin(*(g for g, s in shares.items() if s > 0)) if any(s > 0 for s in shares.values()) else F.lit(False)).isEmpty():
        planned = planned.withColumn("kind", F.when(F.col("kind") == "target", "target").otherwise("any"))
        shares = {"any": 1.0}
    groups = spark.createDataFrame([(g, float(s)) for g, s in shares.items()], "grp string, share double")
    out = None
    for side, n in (("train", config.n_train), ("test", config.n_test)):
        for name, kinds in (("positive", groups.limit(0).union(spark.createDataFrame([("target", 1.0)], "grp string, share double"))), ("negative", groups)):
            listed = planned.where(F.col("side") == side).select(F.col("kind").alias("grp"), "phrase")
            part = phrases.schedule(kinds, listed.join(F.broadcast(kinds.select("grp")), "grp", "left_semi"), n).withColumn("split", F.lit(f"{name}_{side}"))
            out = part if out is None else out.unionByName(part)
    return out


def run_generate(config: Config, plan: DataFrame, load, present: DataFrame | None = None, speakers: int = 100, lengths: tuple[float, ...] = (0.75, 1.0, 1.25)) -> DataFrame:
    """split, clip_idx, phrase, voices, settings, samples, problem of the planned clips that are not there yet.

    load gives a synthesizer, such as synthesis.Tones; present has split and clip_idx of the clips there are.
    """
    clips = synthesis.plan_clips(plan, speakers, list(lengths))
    if present is not None:
        clips = sampling.plan_missing(clips, present, "split", "clip_idx")
    return synthesis.synthesize(clips, load)


def build_streams(clips: DataFrame, config: Config, background: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks (stream_id, seq, samples), spans (stream_id, clip_no, start, end in hops) and streams (stream_id, kind, hours).

    clips: stream_id, kind, idx (dense from 0), samples. A stream is two seconds of silence, then every clip with a
    gap after it; voiced hours are those of the clips alone. background: stream_id, samples, laid under the whole
    stream in turns at streaming.snr_db below the clips' mean power.
    """
    rate, s = SAMPLE_RATE, config.streaming
    lead, gap = 2 * rate, int(s.gap_seconds * rate)
    sized = clips.select("stream_id", "kind", F.col("idx").alias("hop"), F.col("samples").cast("array<double>").alias("samples")).withColumn("length", F.size("samples"))
    placed = windows.layout(sized, lead, gap)
    spans = placed.select("stream_id", F.col("hop").alias("clip_no"), F.floor(F.col("start") / HOP_SAMPLES).alias("start"), F.floor(F.col("stop") / HOP_SAMPLES).alias("end"))
    streams = placed.groupBy("stream_id", "kind").agg((F.sum("length") / rate / 3600).alias("hours"))
    voiced = placed.select("stream_id", (F.col("hop") + 1).alias("seq"), F.col("start").alias("at"), F.concat("samples", signal.zeros(F.lit(gap))).alias("samples"))
    chunks = streams.select("stream_id", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("at"), signal.zeros(F.lit(lead)).alias("samples")).unionByName(voiced)
    if background is not None:
        power = placed.groupBy("stream_id").agg((F.sum(signal.power(F.col("samples")) * F.col("length")) / F.sum("length")).alias("__p"))
        bed = background.select("stream_id", F.col("samples").cast("array<double>").alias("__bed")).join(power, "stream_id")
        own = signal.power(F.col("__bed"))
        bed = bed.withColumn("__gain", F.when(own > 0, F.sqrt(F.col("__p") / (own * F.pow(F.lit(10.0), F.lit(s.snr_db) / 10)))).otherwise(0.0))
        under = chunks.join(bed, "stream_id", "left")
        laid = signal.added(F.col("samples"), signal.scaled(signal.tiled(F.col("__bed"), F.col("at"), F.size("samples")), F.col("__gain")))
        chunks = under.select("stream_id", "seq", "at", F.when(F.col("__bed").isNotNull(), laid).otherwise(F.col("samples")).alias("samples"))
    return chunks.select("stream_id", "seq", "samples"), spans, streams


def score_streams(chunks: DataFrame, make, geometry: Geometry = Geometry()) -> DataFrame:
    """stream_id, hop, score of all chunks by the incremental scorer, through a folder that a stream reads; hops of the first window score 0."""
    folder = sinks.scratch(chunks.sparkSession, "chunks")
    feeds.dropped(chunks, folder, "seq")
    found = feeds.run_through(score_audio(feeds.folder_stream(chunks.sparkSession, folder, chunks.schema, 64), make, geometry))
    early = found.select("stream_id").distinct().select("stream_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(geometry.window_hops - 2).cast("bigint"))).alias("hop"), F.lit(0.0).alias("score"))
    return found.unionByName(early)


def placement(config: Config, split: str) -> dict:
    """What happens to a split's clips before rooms and noise: context before them, and phrases rebuilt from two halves, for positives only."""
    a, positive = config.augmentation, split.startswith("positive")
    return {
        "jitter": a.jitter_samples, "context": a.context_probability, "near_miss": a.near_miss_context_probability if positive else 0.0, "split": a.split_probability if positive else 0.0,
        "context_gap": tuple(sorted(a.context_gap_samples)), "split_gap": tuple(sorted(a.split_gap_samples)),
    }


def with_contexts(config: Config, clips: DataFrame, split: str, contexts: DataFrame, near_misses: DataFrame, pairs: DataFrame, samples: int = 32_000) -> DataFrame:
    """split, clip_idx, samples: the clips of a split at the end of their windows, some after other speech, some rebuilt from two halves.

    clips: clip_idx, samples. contexts and near_misses: ord dense from 0, samples; pairs: ord, left, right. Empty
    tables are drawn from by no clip.
    """
    p, key = placement(config, split), F.concat(F.lit(f"{split}/"), F.col("clip_idx").cast("string"))
    draw = lambda what: share(key, what, config.seed)
    between = lambda what, ends: F.floor(F.lit(ends[0]) + draw(what) * (ends[1] - ends[0] + 1)).cast("int")
    rows = clips.select("clip_idx", F.col("samples").cast("array<double>").alias("samples"))
    for name, table, columns in (("context", contexts, ["samples"]), ("near_miss", near_misses, ["samples"]), ("split", pairs, ["left", "right"])):
        picked = sampling.pick(rows.select("clip_idx"), "clip_idx", table.select("ord", *(F.col(c).cast("array<double>").alias(f"{name}_{c}") for c in columns)), f"{split} {name}")
        rows = rows.join(picked, "clip_idx", "left")
    halves = signal.joined(F.col("split_left"), between("split gap", p["split_gap"]), F.col("split_right"))
    rows = rows.withColumn("samples", F.when((draw("split") < p["split"]) & F.col("split_left").isNotNull(), halves).otherwise(F.col("samples")))
    other = F.when((draw("near miss") < p["near_miss"]) & F.col("near_miss_samples").isNotNull(), F.col("near_miss_samples")).when(draw("context") < p["context"], F.col("context_samples"))
    rows = rows.withColumns({"__other": F.coalesce(other, F.array().cast("array<double>")), "__jitter": between("jitter", (0, p["jitter"])), "__gap": between("gap", p["context_gap"]), "__gain": draw("gain") * -6})
    placed = signal.with_context(F.col("samples"), F.col("__other"), samples, F.col("__jitter"), F.col("__gap"), F.col("__gain"))
    return rows.select(F.lit(split).alias("split"), "clip_idx", placed.alias("samples"))


def augment_plan(config: Config, clips: DataFrame) -> DataFrame:
    """Each clip once a round, with the draws of its augmentation as columns: snr_db, jitter, gains, drive, with_response."""
    a = config.augmentation
    key = F.concat_ws("/", "split", F.col("clip_idx").cast("string"), F.col("round").cast("string"))
    draw = lambda purpose: share(key, purpose, config.seed)
    rounds = clips.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(a.rounds - 1))))
    gains = F.array(*((draw(f"gain {i}") * 12 - 6) for i in range(8)))
    return rounds.select(
        "*", (F.lit(a.snr_low_db) + draw("snr") * (a.snr_high_db - a.snr_low_db)).alias("snr_db"), F.floor(draw("jitter") * a.jitter_samples).cast("int").alias("jitter"),
        F.when(draw("eq") < a.eq_probability, gains).alias("gains"), F.when(draw("distort") < a.distortion_probability, 1 + 4 * draw("drive")).alias("drive"),
        (draw("response") < a.response_probability).alias("with_response"),
    )


def run_augment(config: Config, clips: DataFrame, backgrounds: DataFrame, responses: DataFrame, samples: int = 32_000) -> DataFrame:
    """split, clip_idx, round, samples: placed at the end of the window, equalised, distorted, in a room, over a background.

    clips: split, clip_idx, samples. backgrounds and responses: ord dense from 0, samples.
    """
    plan = augment_plan(config, clips).withColumn("key", F.concat_ws("/", "split", F.col("clip_idx").cast("string"), F.col("round").cast("string")))
    roomy = sampling.pick(plan, "key", responses.select("ord", F.col("samples").cast("array<double>").alias("room")), "room")
    noisy = sampling.pick(roomy, "key", backgrounds.select("ord", F.col("samples").cast("array<double>").alias("noise")), "noise")
    placed = noisy.withColumn("samples", signal.end_aligned(F.col("samples").cast("array<double>"), samples, F.col("jitter"))).withColumn("response", F.when(F.col("with_response"), F.col("room")))
    heard = dsp.per_row(placed.select("split", "clip_idx", "round", "key", "snr_db", "noise", "gains", "drive", "response", "samples"), "samples", "wet", T.ArrayType(T.DoubleType()), dsp.augment)
    offset = F.floor(share(F.col("key"), "offset", config.seed) * F.size("noise")).cast("int")
    bed = heard.withColumn("bed", signal.tiled(F.col("noise"), offset, F.lit(samples)))
    gained = bed.withColumn("level", signal.snr_gain(F.col("wet"), F.col("bed"), F.col("snr_db")))
    return gained.select("split", "clip_idx", "round", F.zip_with(F.col("wet"), signal.scaled(F.col("bed"), F.col("level")), lambda a, b: a + b).alias("samples"))


def run_extraction(clips: DataFrame, embed, width: int = 76, steps: int = 16) -> DataFrame:
    """Add features: the last `steps` embeddings of a clip. embed: a loader for scoring.score_with, or None for mean bands."""
    bands = dsp.per_row(clips, "samples", "bands", T.ArrayType(T.ArrayType(T.DoubleType())), dsp.mel).withColumn("bands", signal.floored(F.col("bands")))
    if embed is not None:
        return scoring.score_with(bands, "bands", embed, "features").drop("bands")
    blocks = F.transform(signal.mel_windows(F.col("bands"), width), lambda w: F.transform(F.sequence(F.lit(0), F.lit(dsp.MEL_BANDS - 1)), lambda b: F.aggregate(w, F.lit(0.0), lambda s, r: s + F.element_at(r, b + 1)) / width))
    zero = F.array_repeat(F.lit(0.0), dsp.MEL_BANDS)
    return bands.withColumn("features", windows.last_padded(blocks, steps, zero)).drop("bands")


def run_train(config: Config, rows: DataFrame, validate, log_path: str | None = None) -> training.Trained:
    """The three-phase trainer over rows of cls, features (an array a step) and label."""
    flat = sampling.dense_order(rows.withColumn("__id", F.monotonically_increasing_id()), "cls", "__id").select("cls", "ord", F.flatten(F.col("features").cast("array<array<double>>")).alias("x"), F.col("label").cast("double").alias("y"))
    plan = training.Plan(config.batch, config.steps, target_fpph=config.streaming.target_fa_per_hour, smoothing=config.smoothing, mixup=config.mixup, unmixed=tuple(config.unmixed), hidden=HIDDEN[config.size.value], seed=config.seed)
    return training.train(flat, plan, validate, log_path)


def run_train_verifier(config: Config, rows: DataFrame, test: DataFrame, log_path: str | None = None):
    """The verifier's trainer over rows of cls, features and label, and test clips of kind and features."""
    flat = sampling.dense_order(rows.withColumn("__id", F.monotonically_increasing_id()), "cls", "__id").select("cls", "ord", F.flatten(F.col("features").cast("array<array<double>>")).alias("x"), F.col("label").cast("double").alias("y"))
    clips = test.select("kind", F.flatten(F.col("features").cast("array<array<double>>")).alias("x"))
    return training.train_verifier(flat, clips, training.Plan(config.batch, config.steps, hidden=HIDDEN[config.size.value], seed=config.seed), config.verifier_recall, log_path=log_path)


def run_export(trained: dict, about: dict, spark: SparkSession, path: str) -> None:
    """The head's weights and its threshold as JSON."""
    sinks.save_model(spark, path, {k: v.ravel().tolist() for k, v in trained.items()}, {**about, "shapes": {k: list(v.shape) for k, v in trained.items()}})


def run_eval(scores: DataFrame, targets: list[float]) -> dict[str, DataFrame]:
    """The clip evaluation: metrics at 0.5, the DET curve and its area, the best thresholds."""
    curve = metrics.det_curve(scores)
    return {"metrics": metrics.clip_metrics(scores), "det": curve, "aut": metrics.area_under_det(curve), "best": metrics.best_thresholds(metrics.sweep(scores), targets)}


def run_streaming_eval(config: Config, hops: DataFrame, spans: DataFrame, streams: DataFrame, verifier: str | None = None, gate: str | None = None) -> dict[str, DataFrame]:
    """The streaming evaluation: pooled DET over 99 thresholds, the selected point, summaries at the configured threshold and at the selected one, and a report.

    streams: stream_id, kind, hours of voice. A column `gate` (whether a hop may be scored) and one of a verifier's
    scores act on the hops before runs are looked for. Raises where there is no positive stream.
    """
    if streams.where("kind = 'positive'").isEmpty():
        raise ValueError("a streaming evaluation needs a positive stream")
    if gate:
        hops = hops.withColumn("score", windows.gated(F.col("score"), F.col(gate)))
    if verifier:
        hops = matching.verified_hops(hops, verifier, config.streaming.verifier_threshold)
    s = config.streaming
    skip = max(1, round(s.debounce_seconds / HOP_SECONDS))
    spark = hops.sparkSession
    steps = list(range(1, 100))
    fires = windows.debounced(matching.at_thresholds(hops, steps, 100, s.consecutive), skip, ("stream_id", "step"))
    det = matching.pooled_det(fires, spans, streams, spark.createDataFrame([(i,) for i in steps], "step int"), s.tail_hops)
    selected = matching.select_point(det, s.target_fa_per_hour)
    summary = matching.stream_summary(windows.detections(hops, s.threshold, skip, s.consecutive), spans, streams, s.tail_hops)
    chosen = fires.join(F.broadcast(selected.select("step")), "step").select("stream_id", "hop")  # one row
    at_selected = matching.stream_summary(chosen, spans, streams, s.tail_hops)
    return {"det": det, "selected": selected, "summary": summary, "at_selected": at_selected, "report": sinks.report(at_selected)}


def evaluation_sets(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """set, kind, path of the evaluation: the project's own sets beside the default ones, whose names they take over."""
    return own.unionByName(defaults.join(own.select("set"), "set", "left_anti"))


def clips_of_sets(sets: DataFrame, files: DataFrame, cap: int) -> DataFrame:
    """set, kind, path, idx of at most `cap` clips of each set, drawn by hash and numbered in order of path; sets without clips are left out."""
    some = sampling.sample(files.join(sets.select("set", "kind"), "set"), "path", cap, "set", purpose="clips")
    return sampling.numbered(some, "idx", F.lit(0), ["path"], ("set",))


def write_split(rows: DataFrame, path: str, *keys: str) -> None:
    """Append what a split table lacks, partitioned by split: a run that was cut short goes on where it stopped."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        rows = sampling.plan_missing(rows, spark.read.parquet(path), *keys)
    rows.write.mode("append").partitionBy("split").parquet(path)
