"""Gradients, draws and both trainers on features that can be told apart."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, sampling, scoring, training


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 6)), rng.random(20)
    for hidden in (0, 5):
        weights = training.Head(6, hidden, 1).weights
        weights = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in weights.items()}
        _, g = training.Head.gradient(weights, x, y, 4.0)
        for name, w in weights.items():
            for at in list(np.ndindex(w.shape))[:4]:
                moved = []
                for e in (1e-5, -1e-5):
                    other = {k: v.copy() for k, v in weights.items()}
                    other[name][at] += e
                    moved.append(training.Head.gradient(other, x, y, 4.0)[0])
                assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-5)


def test_focal_loss_of_soft_labels(spark):
    rows = spark.createDataFrame([(0.9, 1.0), (0.2, 0.0), (0.6, 0.3)], "p double, y double")
    for r in rows.select("*", metrics.focal_loss(F.col("p"), F.col("y")).alias("loss")).collect():
        right = r.p * r.y + (1 - r.p) * (1 - r.y)
        assert r.loss == pytest.approx((1 - right) ** 2 * -(r.y * np.log(r.p) + (1 - r.y) * np.log(1 - r.p)))


def test_beta_and_mixup(spark):
    draws = [r.b for r in spark.range(3000).select(sampling.beta(F.col("id"), "x", 0.3).alias("b")).collect()]
    assert 0 <= min(draws) and max(draws) <= 1 and np.mean(draws) == pytest.approx(0.5, abs=0.03) and np.var(draws) == pytest.approx(0.25 / 1.6, abs=0.02)
    rows = spark.createDataFrame([(b, 10 * b + i, [float(i), 1.0], float(i % 2), "keep" if i == 4 else "mix") for b in range(5) for i in range(5)], "batch long, id long, x array<double>, y double, cls string")
    out = sampling.mixup(rows, "id", "batch", "x", "y", 0.5, F.col("cls") != "keep").collect()
    assert len(out) == 25 and all(r.x == [4.0, 1.0] and r.y == 0.0 for r in out if r.cls == "keep")
    assert all(0 <= r.x[0] <= 3 and r.x[1] == pytest.approx(1.0) for r in out if r.cls == "mix")
    assert any(0 < r.y < 1 for r in out) and sum(r.x[0] for r in out if r.batch == 1) == pytest.approx(10.0)


def separable(spark, n=60, dim=12):
    rng = np.random.default_rng(3)
    rows = [("positive" if i % 3 == 0 else "adversarial_negative", i // 3 if i % 3 == 0 else i - i // 3 - 1, (rng.normal(size=dim) * 0.3 + (1 if i % 3 == 0 else -1)).tolist(), float(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "cls string, ord long, x array<double>, y double").cache()


@pytest.mark.parametrize("hidden", [0, 4])
def test_three_phases(spark, tmp_path, hidden):
    rows = separable(spark)
    held = rows.select(F.when(F.col("y") > 0.5, "positive").otherwise("background").alias("kind"), "x")

    def validate(weights):
        m = metrics.clip_metrics(training.scored(held, weights)).first()
        return {"fpph": m.fpph, "recall": m.recall, "accuracy": m.accuracy}

    plan = training.Plan({"positive": 6, "adversarial_negative": 10, "absent": 3}, steps=20, rate=0.1, smoothing=0.1, mixup=0.2, hidden=hidden)
    done = training.train(rows, plan, validate, f"file://{tmp_path}/log.json")
    assert done.final["recall"] >= 0.98 and done.final["accuracy"] >= 0.98
    log = json.loads((tmp_path / "log.json").read_text())
    assert [e["phase"] for e in log if "note" not in e][-1] == 3 and log[-1]["note"] == "averaged" and len(done.checkpoints) == 5 + 1 + 1
    assert {c["phase"] for c in done.checkpoints} == {1, 2, 3}


def test_negatives_weigh_more_after_a_bad_phase(spark):
    seen = []
    plan = training.Plan({"positive": 2, "adversarial_negative": 2}, steps=10, negative_weight=3.0, target_fpph=1.0)
    real = training.summed_gradient
    training.summed_gradient = lambda batch, weights, negative: seen.append(negative) or real(batch, weights, negative)
    try:
        training.train(separable(spark), plan, lambda w: {"fpph": 5.0, "recall": 0.5, "accuracy": 0.5})
    finally:
        training.summed_gradient = real
    assert seen[0] == 1.0 and seen[9] == pytest.approx(1 + 2 * 0.9) and len(seen) == 12


def test_verifier(spark):
    rows = separable(spark)
    test = rows.select(F.when(F.col("y") > 0.5, "positive").otherwise("near_miss").alias("kind"), "x")
    plan = training.Plan({"positive": 6, "adversarial_negative": 6}, steps=20, rate=0.1)
    weights, final = training.train_verifier(rows, test, plan, 0.9)
    assert final["recall"] >= 0.9 and final["near_miss_accept"] <= 0.1
    _, bare = training.train_verifier(rows, test.limit(0), training.Plan(plan.shares, steps=2))
    assert bare["threshold"] == 0.5
    stored = scoring.Verifier.stored(lambda: lambda x: training.Head.forward(weights, x)[0], {"threshold": final["threshold"]})
    assert stored.accepted(test, "x").where("kind = 'positive' and accepted").count() >= 18
    assert scoring.Verifier.stored(lambda: None, {}).threshold == 0.5


def test_scores_keep_other_columns(spark):
    rows = separable(spark).withColumn("features", F.lit("mine")).withColumn("score", F.lit("old"))
    model = scoring.train_hardening(rows, "x", "y")
    out = scoring.apply_logistic(model, rows, "x")
    assert out.columns == ["cls", "ord", "x", "y", "features", "score"] and out.first().features == "mine"
    again = scoring.score_with(rows, "x", lambda: lambda x: x.mean(1))
    assert again.columns.count("score") == 1 and again.where("score > 0 and y < 0.5").count() == 0
