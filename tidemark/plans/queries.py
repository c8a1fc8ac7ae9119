"""Queries over the base tables, one or more for each operator family; `oracles` holds their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dsp, signal
from tidemark.operators import matching, metrics, phrases, sampling, scoring, windows
from tidemark.sources import dictionary, features, sinks, tables
from tidemark.sources.tables import read
from tidemark.streaming import feeds
from tidemark.streaming.detector import Policy, detect
from tidemark.streaming.scorer import Geometry, Model, score_audio

#: Debounce of two seconds in hops, the default threshold, hops of a hit window's tail.
SKIP, THRESHOLD, TAIL = windows.debounce_hops(2.0), 0.5, 1


def hops(spark: SparkSession, d: str) -> DataFrame:
    return tables.hop_scores(read(spark, d, "events"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    return tables.clip_scores(read(spark, d, "events"))


def stream(spark: SparkSession, d: str) -> DataFrame:
    return tables.embedding_stream(read(spark, d, "embeddings"))


def q01_clip_metrics(spark, d):
    return metrics.clip_metrics(clips(spark, d), THRESHOLD)


def q02_threshold_sweep(spark, d):
    return _rounded(metrics.sweep(clips(spark, d)).drop("step"), "recall", "fpr", "fpph", "accuracy")


def q03_best_threshold(spark, d):
    return _rounded(metrics.best_thresholds(metrics.sweep(clips(spark, d)), [0.5, 20_000.0, 30_000.0]), "recall", "fpph", "accuracy")


def q04_det_curve(spark, d):
    return _rounded(metrics.det_curve(clips(spark, d)), "fpr", "fnr")


def q05_aut(spark, d):
    return _rounded(metrics.area_under_det(metrics.det_curve(clips(spark, d))), "aut")


def _weighted(x):
    """One number of all components of a vector."""
    return F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v) / F.size(x)


def q06_hop_windows(spark, d):
    s = stream(spark, d).withColumn("x", _weighted(F.col("emb")))
    full = windows.stride_windows(s, "x").select("stream_id", "hop", F.lit("stride").alias("kind"), "window")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("hop", "x"))), lambda r: r["x"])
    last = s.groupBy("stream_id").agg(F.max("hop").alias("hop"), ordered.alias("all"))
    padded = last.select("stream_id", "hop", F.lit("padded").alias("kind"), windows.last_padded(F.col("all"), 20, F.lit(0.0)).alias("window"))
    return full.union(padded).select("stream_id", "hop", "kind", F.size("window").alias("n"), *(F.round(F.col("window")[i], 6).alias(f"w{i}") for i in (0, 7, 15)))


def q07_window_scores_maxpool(spark, d):
    s = stream(spark, d).withColumn("x", _weighted(F.col("emb")))
    scored = windows.stride_windows(s, "x").select("stream_id", (signal.total(F.col("window")) / 16).alias("score"))
    return _rounded(windows.max_pool(scored, "stream_id"), "score")


def q08_run_detection(spark, d):
    h = hops(spark, d)
    fires = windows.run_fires(h, 0.3, 3).select("stream_id", "hop", F.lit(1).alias("fires"))
    return windows.run_lengths(h, 0.3).select("stream_id", "hop", F.col("run").cast("long").alias("run")).join(fires, ["stream_id", "hop"], "left").na.fill(0, ["fires"])


def q09_debounced_detections(spark, d):
    return windows.detections(hops(spark, d), THRESHOLD, SKIP)


def q10_stream_false_accepts(spark, d):
    h = hops(spark, d).where("kind <> 'positive'")
    fires = windows.detections(h, THRESHOLD, SKIP).groupBy("stream_id").agg(F.count("*").alias("fires"))
    hours = h.groupBy("stream_id").agg((F.count("*") * tables.HOP_SECONDS / 3600).alias("hours"))
    rows = hours.join(fires, "stream_id", "left").na.fill(0, ["fires"])
    return _rounded(rows.withColumn("fa_per_hour", metrics.per_hour(F.col("fires"), F.col("hours"))), "hours", "fa_per_hour")


def q11_interval_hits(spark, d):
    h = hops(spark, d)
    return matching.interval_hits(windows.detections(h, THRESHOLD, SKIP), tables.targets(h), TAIL)


def q12_set_summary(spark, d):
    h = hops(spark, d)
    sets = tables.streams(h)
    return _rounded(matching.stream_summary(windows.detections(h, THRESHOLD, SKIP), tables.stream_clips(h, sets), sets, TAIL), "miss_rate", "fa_per_clip", "hours", "fa_per_hour")


def _det(spark, d):
    h = hops(spark, d)
    steps, sets = list(range(1, 10)), tables.streams(h)
    fires = windows.debounced(matching.at_thresholds(h, steps, 10), SKIP, ("stream_id", "step"))
    return matching.pooled_det(fires, tables.stream_clips(h, sets), sets, spark.createDataFrame([(i,) for i in steps], "step int"), TAIL)


def q13_streaming_det(spark, d):
    return _rounded(_det(spark, d), "miss_rate", "near_miss_rate", "fa_per_hour")


def q13b_streaming_select(spark, d):
    det = _det(spark, d)
    chosen = [matching.select_point(det, t).withColumn("target", F.lit(t)) for t in (1500.0, 0.5)]
    return _rounded(chosen[0].unionByName(chosen[1]), "miss_rate", "near_miss_rate", "fa_per_hour")


def q14_rolling_gate(spark, d):
    h = hops(spark, d).withColumn("speech", F.col("kind") != "near_miss")
    opened = windows.rolling_gate(h, "speech", 5, 4)
    return opened.select("stream_id", "hop", "gate_open", F.round(windows.gated(F.col("score"), F.col("gate_open")), 6).alias("score"))


def q15_verifier_gate(spark, d):
    h = hops(spark, d)
    second = h.select("stream_id", "hop", ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("verifier_score"))
    fires = windows.detections(h, THRESHOLD, SKIP)
    staged = matching.verified(h, second, fires)
    named = matching.verifier_by_name(staged.withColumn("name", F.col("kind")), spark.createDataFrame([("positive", 0.3), ("near_miss", 0.6)], "name string, verifier double"))
    return named.select("stream_id", "hop", F.round(matching.reject(F.col("score"), F.col("verifier_score"), 0.4), 6).alias("score"), "verifier_score", "verifier")


def q16_recall_threshold(spark, d):
    return _rounded(metrics.recall_threshold(clips(spark, d), [0.5, 0.9, 1.0]), "threshold", "recall", "near_miss_accept")


def _checkpoints(spark, d):
    e = read(spark, d, "events")
    day = F.dayofyear("ts").alias("step")
    hit = (F.col("value") >= 50.0).cast("double")
    positive = F.col("event_type") == "purchase"
    rows = e.groupBy(day).agg(F.avg(F.when(positive, hit)).alias("recall"), (F.sum(F.when(~positive, hit)) / 10).alias("fpph"), F.avg(F.when(positive, hit).otherwise(1 - hit)).alias("accuracy"))
    return rows.na.fill(0.0)


def q17_checkpoint_select(spark, d):
    return _rounded(metrics.percentile_filter(_checkpoints(spark, d)), "recall", "fpph", "accuracy")


def q17b_checkpoint_average(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("weights"))
    # the figure that checkpoints are ranked by; of equals the later one wins
    ranked = sampling.top_n(e.withColumn("merit", F.pmod(F.col("vec_id") * 7, F.lit(11))), 3, ["merit", "vec_id"], "label")
    means = metrics.average_weights(ranked.select(F.col("label").alias("name"), "weights"))
    return means.select("name", F.size("weights").alias("n"), *(F.round(F.col("weights")[i], 6).alias(f"w{i}") for i in (0, 31, 63)), F.round(_weighted(F.col("weights")), 6).alias("all"))


def _part_words(spark, d):
    return phrases.vocabulary(read(spark, d, "part"), "p_name")


def _doc_words(spark, d):
    return phrases.vocabulary(read(spark, d, "documents"))


def _dictionary(spark, d):
    return sinks.written(dictionary.spelled_dictionary(_doc_words(spark, d).union(_part_words(spark, d)).distinct()), "dictionary")


def q18_phonetic_neighbours(spark, d):
    return phrases.phonetic_neighbours(_part_words(spark, d), _dictionary(spark, d))


def q18b_spelling_neighbours(spark, d):
    return phrases.neighbours(_part_words(spark, d), _doc_words(spark, d), 2)


def q19_partial_and_swap_phrases(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct()
    partial = names.select("phrase", F.explode(phrases.leave_one_out(phrases.words(F.col("phrase")))).alias("variant"), F.lit("partial").alias("kind")).distinct()
    swapped = phrases.swaps(names, phrases.neighbours(_part_words(spark, d), _doc_words(spark, d), 1)).withColumn("kind", F.lit("swap"))
    return partial.unionByName(swapped)


def q20_split_holdout(spark, d):
    return phrases.holdout(read(spark, d, "part").select("p_name").distinct(), "p_name", 0.2)


def q21_phrase_schedule(spark, d):
    p = read(spark, d, "part")
    items = p.select(F.lower("p_type").alias("grp"), F.col("p_name").alias("phrase")).distinct()
    groups = spark.createDataFrame([("economy", 0.5), ("small", 0.3), ("unknown", 0.2)], "grp string, share double")
    return phrases.schedule(groups, items.join(groups.select("grp"), "grp", "left_semi"), 1000)


def q22_unknown_word_split(spark, d):
    known = sinks.written(phrases.vocabulary(read(spark, d, "benchmark")), "known")
    return phrases.known_cut(_doc_words(spark, d).join(known, "word", "left_anti"), known)


def q23_pair_join(spark, d):
    c = read(spark, d, "conversations").withColumn("length", F.char_length("text"))
    return sampling.consecutive_pairs(c, "turn", "length", "conv_id").select("conv_id", "pair", "left", "right", (F.col("left") + F.col("right") + 160).alias("joined"))


def q24_context_layout(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("hop"), F.char_length("text").alias("length"))
    return windows.layout(c, 32_000, 48_000)


def q25_cyclic_batches(spark, d):
    e = read(spark, d, "embeddings")
    cls = F.when(F.col("label") == 0, "positive").when(F.col("label") < 4, "near_miss").otherwise("background")
    rows = sampling.dense_order(e.select("vec_id", cls.alias("cls")), "cls", "vec_id")
    dealt = sampling.cyclic_batches(rows, {"positive": 7, "near_miss": 11, "background": 32, "absent": 5}, 40)
    return dealt.select("batch", "cls", "k", "vec_id", F.when(F.col("cls") == "positive", 1).otherwise(0).alias("label"))


def q26_mixed_radix(spark, d):
    brands = read(spark, d, "part").select("p_brand").distinct()
    ordered = sampling.numbered(brands, "d0", F.substring(F.md5("p_brand"), 1, 1), [F.md5("p_brand")])
    n = brands.count()
    return sampling.mixed_radix(spark, 20 * n, [n, 2, 3]).join(ordered.withColumn("d0", F.col("d0").cast("int")), "d0").select("i", "p_brand", "d1", "d2")


def q27_mixup_pairs(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("emb"))
    pairs = sampling.mixup_partners(e, "vec_id", "label")
    other = e.select(F.col("vec_id").alias("partner"), F.col("emb").alias("other"))
    mixed = pairs.join(e.drop("label"), "vec_id").join(other, "partner")
    x = signal.blended(F.col("emb"), F.col("other"), F.lit(0.7))
    return mixed.select("label", "vec_id", "partner", F.round(x[0], 6).alias("x0"), F.round(x[63], 6).alias("x63"), F.round(_weighted(x), 6).alias("all"))


def q28_schedules(spark, d):
    s = F.col("id").cast("double")
    return spark.range(0, 1000).select(F.col("id").alias("step"), F.round(sampling.learning_rate(s, 1000, 100, 300, 1e-3), 9).alias("rate"), F.round(sampling.ramp(s, 1000, 1.0, 50.0), 6).alias("weight"))


def q29_snr_gain(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    noise = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("noise"))
    j = e.join(noise, "vec_id")
    g = signal.snr_gain(F.col("x"), F.col("noise"), F.lit(10.0))
    mixed = signal.added(F.col("x"), signal.scaled(F.col("noise"), F.col("factor")))
    # not named as the rounded column: in a lambda that name would mean the rounded one
    return j.withColumn("factor", g).select("vec_id", F.round("factor", 6).alias("gain"), F.round(signal.rms(F.col("x")), 6).alias("rms"), F.round(signal.peak(F.col("x")), 6).alias("peak"), F.round(mixed[0], 6).alias("first"))


def q30_slerp(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    z = signal.slerp(F.col("x"), F.col("y"), F.lit(0.25))
    return e.join(other, "vec_id").select("vec_id", F.round(z[0], 5).alias("z0"), F.round(z[63], 5).alias("z63"), F.round(_weighted(z), 4).alias("all"))


def q31_reblock(spark, d):
    s = stream(spark, d).withColumn("x", F.col("emb")[0])
    return windows.reblock(s, "x").select("stream_id", "block", F.round(F.col("rows")[0], 6).alias("first"), F.round(F.col("rows")[15], 6).alias("last"))


def q32_mel_features(spark, d):
    """Bands of a synthetic waveform of each vector: its components in turn over 32,000 samples."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    wavy = e.withColumn("samples", signal.tiled(F.col("x"), F.lit(0), F.lit(32_000))).drop("x")
    bands = dsp.per_row(wavy, "samples", "bands", T.ArrayType(T.ArrayType(T.DoubleType())), dsp.mel)
    low = signal.floored(F.col("bands"))
    return bands.select("vec_id", F.size("bands").alias("frames"), F.size(signal.mel_windows(F.col("bands"))).alias("windows"), F.round(low[0][0], 4).alias("low0"))


def q33_trained_scorer(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("double").alias("y"))
    return scoring.apply_logistic(scoring.train_hardening(rows, "x", "y"), rows, "x").select("vec_id", "y", F.round("score", 4).alias("score"))


def q34_streaming_detector(spark, d):
    """The detections of q09 by the stateful processor, over hop scores that arrive in a folder drop by drop."""
    rows = hops(spark, d).select("stream_id", "hop", F.lit("wake").alias("name"), "score")
    folder = sinks.scratch(spark, "hops")
    feeds.dropped(rows, folder, "hop")
    return feeds.run_through(detect(feeds.folder_stream(spark, folder, rows.schema, 8), Policy(THRESHOLD, 1, SKIP))).select("stream_id", "hop")


def _background(spark, d):
    """Clips (all that is no purchase) and, as the negative stream, the streams of users, an event a hop."""
    h = hops(spark, d)
    return clips(spark, d).where("kind <> 'background'"), h.where("kind <> 'positive'").select("stream_id", "hop", "score")


def q35_stream_metrics(spark, d):
    own, negative = _background(spark, d)
    return _rounded(metrics.stream_metrics(own, negative, windows.detections(negative, THRESHOLD, SKIP), THRESHOLD), "fpph", "near_miss_rate", "recall", "accuracy")


def q36_stream_best_threshold(spark, d):
    own, negative = _background(spark, d)
    fires = windows.debounced(matching.at_thresholds(negative, list(range(1, 10)), 10), SKIP, ("stream_id", "step"))
    swept = metrics.stream_sweep(own, negative, fires, 10, 1, 9)
    best = metrics.best_thresholds(swept, [0.5, 2000.0, 4000.0], middle=5)
    return _rounded(best, "recall", "fpph", "accuracy")


def _targets(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct()


def q37_adversarial_phrases(spark, d):
    return phrases.adversarial_phrases(_targets(spark, d), _dictionary(spark, d))


def q38_word_swaps(spark, d):
    return phrases.word_swaps(_targets(spark, d), phrases.common_words(read(spark, d, "benchmark"), "text", 40), _dictionary(spark, d))


def q39_gated_run_detection(spark, d):
    """Runs of two, once the second stage has put the hops that it rejects to 0."""
    h = hops(spark, d).withColumn("second", (F.col("event_id") * 7919 % 1000) / F.lit(1000.0))
    return windows.detections(matching.verified_hops(h, "second", 0.4), 0.3, SKIP, 2)


#: A small geometry whose scores SQL can state: frames are means of two values, stretches means of three frames.
SMALL = Geometry(hop=2, step=1, frame=2, window_hops=4, width=3, stride=2, steps=3, depth=0.4)


def _small_model() -> Model:
    return Model(lambda x: ((x[:-1] + x[1:]) / 2)[:, None], lambda s: s.mean(1), lambda v: float(v.mean()))


def q40_incremental_scorer(spark, d):
    """Hop scores of streams of values that come in chunks of seven, drop by drop."""
    rows = tables.chunks(hops(spark, d), "score")
    folder = sinks.scratch(spark, "chunks")
    feeds.dropped(rows, folder, "seq", 3)
    found = feeds.run_through(score_audio(feeds.folder_stream(spark, folder, rows.schema, 8), _small_model, SMALL))
    return _rounded(found, "score")


def q41_class_counts(spark, d):
    e = read(spark, d, "events")
    return features.class_counts(e.select("event_type", F.to_date("ts").cast("string").alias("day")), "event_type", "day")


def q42_context_placement(spark, d):
    """Each vector at the end of 160 samples, the one before it as the speech that comes first."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("context")), "vec_id")
    key = F.col("vec_id").cast("string")
    drawn = j.withColumns({"jitter": F.floor(tables.share(key, "jitter") * 20).cast("int"), "gap": F.floor(tables.share(key, "gap") * 30).cast("int"), "gain": tables.share(key, "gain") * -6})
    placed = drawn.withColumn("w", signal.with_context(F.col("x"), F.col("context"), 160, F.col("jitter"), F.col("gap"), F.col("gain")))
    return placed.select("vec_id", F.size("w").alias("n"), *(F.round(F.col("w")[i], 5).alias(f"w{i}") for i in (0, 40, 70, 120, 159)), F.round(_weighted(F.col("w")), 4).alias("all"))


def q43_background_clips(spark, d):
    e = read(spark, d, "embeddings")
    sources = sampling.dense_order(e.select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(0).alias("g")), "g", "vec_id")
    made = sampling.background_clips(spark, 200, sources.select("ord", "samples"), 100)
    return made.select("clip_idx", "ord", F.size("samples").alias("n"), F.round(F.col("samples")[0], 6).alias("first"), F.round(_weighted(F.col("samples")), 6).alias("all"))


def q44_feature_blocks(spark, d):
    """Examples of 16 steps from the streams of vectors, as the trainer's loader cuts them."""
    s = stream(spark, d).select("stream_id", "hop", "emb")
    cut = windows.reblock(s, "emb").select("stream_id", "block", features.last_steps(F.col("rows"), 12).alias("features"))
    return cut.select("stream_id", "block", F.size("features").alias("steps"), F.round(_weighted(F.flatten("features")), 6).alias("all"))


def q45_verifier_threshold(spark, d):
    """Clips' scores by the mean positive vector, the threshold that accepts nine of ten positives, and what it accepts."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") == 0, "positive").when(F.col("label") < 4, "near_miss").otherwise("background").alias("kind"))
    centre = scoring.centroid(e.where("kind = 'positive'"), "x")
    dots = e.join(F.broadcast(centre)).select("kind", F.round(signal.dot(F.col("x"), F.col("centroid")), 6).alias("score"))  # one row
    return _rounded(metrics.recall_threshold(dots, [0.5, 0.9]), "threshold", "recall", "near_miss_accept")


def q46_cycled_settings(spark, d):
    voices = read(spark, d, "supplier").select(F.col("s_suppkey").alias("voice"), "s_name")
    made = sampling.cycled_settings(spark, 500, 16, [3, 2, 4]).withColumn("voice", F.pmod(F.col("clip_idx"), F.lit(40)))
    return made.join(sampling.voices_within(voices, 30), "voice").select("clip_idx", "batch_no", "d0", "d1", "d2", "voice", "s_name")


def q47_latency_percentiles(spark, d):
    return _rounded(metrics.latency_percentiles(read(spark, d, "events"), "value", "event_type"), "p50", "p95", "p99")


def q48_losses(spark, d):
    y = (F.col("kind") == "positive").cast("double")
    rows = clips(spark, d).withColumn("y", metrics.smoothed(y, 0.1))
    loss = metrics.focal_loss(F.col("score"), F.col("y")) * metrics.negative_weight(F.col("y"), F.lit(3.0))
    return rows.groupBy("kind").agg(F.round(F.avg(loss), 6).alias("loss"), F.count("*").alias("n"))


def q49_sample_formats(spark, d):
    x = F.col("embedding").cast("array<double>")
    rows = read(spark, d, "embeddings").select("vec_id", x.alias("x")).withColumns({"short": signal.to_int16(F.col("x")), "loud": signal.peak_int16(F.col("x")), "rolled": signal.rolled(F.col("x"), F.lit(5))})
    whole = lambda c: _weighted(F.transform(c, lambda v: v.cast("double")))
    return rows.select("vec_id", F.round(whole(F.col("short")), 6).alias("short"), F.round(whole(F.col("loud")), 6).alias("loud"), F.round(_weighted(signal.to_float(F.col("short"))), 9).alias("back"), F.round(F.col("rolled")[0], 6).alias("rolled0"), F.round(_weighted(F.col("rolled")), 6).alias("rolled"), F.round(signal.level_meter(F.col("x")), 6).alias("level"))


def q50_phrase_draws(spark, d):
    p = _targets(spark, d).withColumn("tokens", phrases.words(F.col("phrase")))
    cut = phrases.cut_at(F.col("tokens"), F.col("phrase"))
    return p.select("phrase", F.array_join(phrases.bernoulli_words(F.col("tokens"), F.col("phrase"), 0.5), " ").alias("kept"), F.array_join(cut[0], " ").alias("left"), F.array_join(cut[1], " ").alias("right"))


def q51_clauses(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(phrases.clauses(F.col("text"))).alias("place", "c"))
    return c.select("conv_id", "turn", "place", "c.clause", "c.mark")


def q52_symbol_ids(spark, d):
    """Ids of the letters of names in decomposed form, with pads between, filled up to 40."""
    table = F.create_map(*(x for i, c in enumerate("abcdefghijklmnopqrstuvwxyz ") for x in (F.lit(c), F.lit(i + 1))))
    names = phrases.decomposed(_targets(spark, d), "phrase")
    ids = phrases.pad_ids(phrases.symbol_ids(F.lower("phrase"), table), 0, F.lit(40))
    return names.select("phrase", ids.alias("ids")).select("phrase", F.size("ids").alias("n"), F.array_join("ids", " ").alias("ids"))


def q53_random_pairs(spark, d):
    """Two voices and a room for each clip."""
    made = sampling.speaker_pairs(read(spark, d, "orders").select(F.col("o_orderkey").alias("clip_idx")), 25)
    rooms = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), "n_name")
    return sampling.pick(made, "clip_idx", rooms, "room").select("clip_idx", "a", "b", "n_name")


def q54_verified_stream(spark, d):
    """Detections behind a speech gate and a second stage, by the stateful processor."""
    rows = hops(spark, d).select("stream_id", "hop", F.lit("wake").alias("name"), "score", ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("verifier_score"), (F.col("kind") != "near_miss").alias("speech"))
    folder = sinks.scratch(spark, "hops")
    feeds.dropped(rows, folder, "hop")
    policy = Policy(THRESHOLD, 1, SKIP, gate_window=5, gate_needed=4, verifier=0.4)
    found = feeds.run_through(detect(feeds.folder_stream(spark, folder, rows.schema, 8), policy))
    return found.select("stream_id", "hop", F.round("score", 6).alias("score"), "verifier_score")


def q55_window_scorer(spark, d):
    """Every window of 16 steps scored by a model that is loaded once a task."""
    weights = [(i + 1) / 64 for i in range(64)]
    load = lambda: lambda x: (x @ weights).mean(1)
    scored = scoring.score_with(windows.stride_windows(stream(spark, d), "emb"), "window", load, dtype=float)
    return _rounded(scored.select("stream_id", "hop", "score"), "score")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


QUERIES = {n: f for n, f in sorted(globals().items()) if n[0] == "q" and n[1:3].isdigit()}
