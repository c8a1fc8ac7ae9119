"""Dictionaries, feature tables, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import audio, dictionary, features, sinks


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text(";;; a comment\nZUCK  Z AH1 K\nHEY(1)  HH EH1\nHEY  HH EY1\nTWICE  T W AY1 S\nTWICE  T OW1\nBARE\n\n")
    got = {r.word: r.phones for r in dictionary.read_dictionary(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {"zuck": ["Z", "AH1", "K"], "hey": ["HH", "EY1"], "twice": ["T", "OW1"]}
    words = spark.createDataFrame([("heat",), ("cat",), ("kat",)], "word string")
    assert [r.phones for r in dictionary.spelled_dictionary(words).collect()] == [["H", "E1", "T"], ["K", "A1", "T"], ["K", "A1", "T"]]


def examples(spark, n, steps, dim=4):
    return spark.range(n).select(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.col("id") * 1000 + s * 10 + i).cast("float"))).alias("features"))


def test_tagged_examples(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    examples(spark, 10, 16).write.parquet(path("a"))
    examples(spark, 5, 24).write.parquet(path("long"))
    spark.range(70).select(F.col("id").alias("hop"), F.array_repeat(F.col("id").cast("double"), 4).alias("emb")).write.parquet(path("stream"))
    with pytest.warns(UserWarning, match="absent"):
        got = features.tagged_examples(spark, {"a": path("a"), "absent": path("none"), "long": path("long"), "stream": path("stream")}, 16, 4).collect()
    assert {(r.cls, r.class_id) for r in got} == {("a", 0), ("long", 2), ("stream", 3)} and all(len(r.features) == 16 for r in got)
    assert sum(r.cls == "stream" for r in got) == 4  # the rest of the stream is dropped
    assert sorted(r.features[0][0] for r in got if r.cls == "long") == [1000.0 * i + 80 for i in range(5)]  # the last steps
    for bad, what in ((examples(spark, 1, 8), "fewer than 16"), (examples(spark, 1, 16, 3), "not 4 numbers")):
        bad.write.mode("overwrite").parquet(path("bad"))
        with pytest.raises(Exception, match=what):
            features.tagged_examples(spark, {"bad": path("bad")}, 16, 4).collect()
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        features.tagged_examples(spark, {"x": path("none")})
    assert {r.cls: r.n for r in features.class_counts(spark.createDataFrame([(r.cls,) for r in got], "cls string"), "cls").collect()} == {"a": 10, "long": 5, "stream": 4}


def test_validation_and_verifier_tables(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    examples(spark, 4, 16).write.parquet(path("pos"))
    examples(spark, 6, 20).write.parquet(path("neg"))
    spark.range(1015).select(F.lit(1).alias("stream_id"), F.col("id").alias("hop"), F.array_repeat(F.lit(1.0), 4).alias("emb")).write.parquet(path("background"))
    v = features.validation(spark, path("pos"), [path("neg"), path("none")], path("background"), 4)
    assert v.positive.count() == 4 and v.negative.count() == 6
    assert v.stream_hours().first()[0] == pytest.approx(1000 * 0.08 / 3600) and v.clip_hours.first()[0] == pytest.approx(12 / 3600)
    again = features.validation(spark, path("none"), [path("neg")], path("pos"), 4)  # a background of examples is more clips
    assert again.negative.count() == 10 and again.stream.count() == 0 and again.positive.count() == 0 and again.stream_hours().first()[0] == 0
    test = features.verifier_test(spark, path("pos"), path("neg"), 16)
    assert {r.kind: len(r.features) for r in test.collect()} == {"positive": 16, "near_miss": 16} and features.verifier_test(spark, path("none"), path("none")).count() == 0
    with pytest.raises(FileNotFoundError):
        features.required(spark, {"x": path("none")})


def test_text_metrics_and_curves(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    row = spark.createDataFrame([(0.5, float("inf"), 3)], "recall double, fpph double, n int")
    sinks.write_metrics(row, at("m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"recall": 0.5, "fpph": "inf", "n": 3}
    for i in range(3):
        log = sinks.append_metrics(spark, at("log.json"), {"step": i, "fpph": float("nan")})
    assert [e["step"] for e in log] == [0, 1, 2] and json.loads((tmp_path / "log.json").read_text()) == log
    assert sinks.read_text(spark, at("none")) is None
    curve = spark.createDataFrame([(0.0, 1.0), (0.5, 0.25), (1.0, 0.0), (None, 1.0)], "fpr double, fnr double")
    assert sinks.write_curve(curve, at("det.svg"), "fpr", "fnr", "DET") == 3 and "<polyline" in (tmp_path / "det.svg").read_text()
    scores = spark.createDataFrame([(s, h, h / 10) for s in (1, 2) for h in range(5)], "stream_id long, hop long, score double")
    sinks.write_scores(scores, at("scores"))
    assert (tmp_path / "scores/stream_id=2").is_dir() and spark.read.parquet(at("scores")).where("stream_id = 1").count() == 5
    sinks.save_model(spark, at("model.json"), {"w": [1.0, 2.0]}, {"threshold": 0.7})
    assert sinks.load_model(spark, at("model.json")) == ({"w": [1.0, 2.0]}, {"threshold": 0.7})
    with pytest.raises(FileNotFoundError):
        sinks.load_model(spark, at("other.json"))
    assert sinks.resource(spark, "model.json", at("nowhere"), at("")[:-1]) == f"file://{tmp_path}/model.json"
    with pytest.raises(FileNotFoundError):
        sinks.resource(spark, "no such file", at("")[:-1])


def test_ingest_is_done_once(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    wanted = {f"file://{tmp_path}/a": f"file://{tmp_path}/to/a", f"file://{tmp_path}/none": f"file://{tmp_path}/to/none"}
    first = {r.target.rsplit("/", 1)[1]: r.state for r in sinks.ingest(spark, wanted).collect()}
    assert first["a"] == "copied" and first["none"] not in ("copied", "present") and (tmp_path / "to/a").read_text() == "one"
    assert {r.target.rsplit("/", 1)[1]: r.state for r in sinks.ingest(spark, wanted).collect()}["a"] == "present"


def test_missing_folders_are_warned_of(spark, tmp_path):
    with pytest.warns(UserWarning, match="nothing at"):
        assert audio.scan_wav(spark, str(tmp_path / "none")).count() == 0
