"""Training of small scoring heads: batches dealt by class, three phases, checkpoints chosen and averaged.

Steps are synchronous: the batches of a phase are dealt and mixed as one table, partitioned by step; for each
step the tasks compute the gradient of their rows and the driver moves the weights, a few thousand numbers.
A step reads its own batch only, so its cost does not depend on the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics, sampling
from tidemark.sources.sinks import append_metrics, scratch


@dataclass(frozen=True)
class Plan:
    """What a training run is told."""

    shares: dict[str, int]
    steps: int = 200
    rate: float = 1e-2
    decay: float = 1e-2
    negative_weight: float = 10.0
    target_fpph: float = 0.5
    smoothing: float = 0.0
    mixup: float = 0.0
    unmixed: tuple[str, ...] = ()
    hidden: int = 0
    seed: int = 7

    @property
    def phases(self) -> list[tuple[int, int, float]]:
        """number, steps and rate of each: the whole, then two short ones at a tenth and a hundredth of the rate."""
        return [(1, self.steps, self.rate), (2, self.steps // 10, self.rate / 10), (3, self.steps // 10, self.rate / 100)]


class Head:
    """A logistic head, or one with a hidden layer: scores and gradients of batches."""

    def __init__(self, dim: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.weights = {"w": rng.normal(size=(dim, hidden)) / np.sqrt(dim), "b": np.zeros(hidden), "v": rng.normal(size=hidden) / np.sqrt(hidden), "c": np.zeros(1)} if hidden else {"v": np.zeros(dim), "c": np.zeros(1)}

    @staticmethod
    def forward(weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(0, x @ weights["w"] + weights["b"]) if "w" in weights else x
        return 1 / (1 + np.exp(-np.clip(hidden @ weights["v"] + weights["c"], -30, 30))), hidden

    @classmethod
    def gradient(cls, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, negative: float, gamma: float = 2.0) -> tuple[float, dict[str, np.ndarray]]:
        """Sums over a batch of the weighted focal loss and of its gradient."""
        p, hidden = cls.forward(weights, x)
        p = np.clip(p, 1e-7, 1 - 1e-7)
        right = p * y + (1 - p) * (1 - y)
        cross = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        scale = np.where(y < 0.5, negative, 1.0)
        loss = float((scale * (1 - right) ** gamma * cross).sum())
        by_p = (1 - right) ** gamma * (p - y) / (p * (1 - p)) - gamma * (1 - right) ** (gamma - 1) * (2 * y - 1) * cross
        z = scale * by_p * p * (1 - p)
        out = {"v": hidden.T @ z, "c": np.array([z.sum()])}
        if "w" in weights:
            back = np.outer(z, weights["v"]) * (hidden > 0)
            out |= {"w": x.T @ back, "b": back.sum(0)}
        return loss, out


class AdamW:
    def __init__(self, weights: dict[str, np.ndarray], decay: float):
        self.weights, self.decay, self.n = weights, decay, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, g in gradient.items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
            moved = self.mean[k] / (1 - 0.9**self.n) / (np.sqrt(self.square[k] / (1 - 0.999**self.n)) + 1e-8)
            self.weights[k] = self.weights[k] * (1 - rate * self.decay) - rate * moved


def rate_at(step: int, total: int, warmup: int, hold: int, peak: float) -> float:
    """The schedule of sampling.learning_rate as a number."""
    if step < warmup:
        return peak * step / max(1, warmup)
    if step < warmup + hold:
        return peak
    return peak * 0.5 * (1 + float(np.cos(np.pi * (step - warmup - hold) / max(1, total - warmup - hold))))


def dealt(rows: DataFrame, plan: Plan, phase: int, steps: int) -> DataFrame:
    """batch, x, y of a phase, written by batch: classes in turn, mixed up and smoothed. rows: cls, ord, x, y."""
    spark = rows.sparkSession
    batches = sampling.cyclic_batches(rows, plan.shares, steps)
    batches = batches.withColumn("batch", F.col("batch").cast("string")).withColumn("x", F.col("x").cast("array<double>"))
    if plan.mixup > 0:
        keyed = batches.withColumn("batch", F.concat_ws("/", F.lit(f"{plan.seed}/{phase}"), "batch"))
        mixed = sampling.mixup(keyed.withColumn("slot", F.xxhash64("batch", "cls", "k")), "slot", "batch", "x", "y", plan.mixup, ~F.col("cls").isin(*plan.unmixed) if plan.unmixed else None)
        batches = mixed.withColumn("batch", F.element_at(F.split("batch", "/"), -1))
    path = scratch(spark, "batches")
    smooth = metrics.smoothed(F.col("y"), plan.smoothing)
    batches.select(F.col("batch").cast("int").alias("batch"), "x", smooth.alias("y")).repartition("batch").write.partitionBy("batch").parquet(path)
    return spark.read.schema("x array<double>, y double, batch int").parquet(path)


def summed_gradient(batch: DataFrame, weights: dict[str, np.ndarray], negative: float) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, rows and gradient of a batch: one row a task comes to the driver."""
    names = sorted(weights)

    def run(batches):
        loss, n, sums = 0.0, 0, {k: np.zeros_like(weights[k]) for k in names}
        for some in batches:
            if some.num_rows:
                x = some.column("x").flatten().to_numpy().reshape(some.num_rows, -1)
                part, g = Head.gradient(weights, x, some.column("y").to_numpy(), negative)
                loss, n = loss + part, n + some.num_rows
                for k in names:
                    sums[k] += g[k]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([np.concatenate([sums[k].ravel() for k in names]).tolist()], pa.list_(pa.float64()))], names=["loss", "n", "g"])

    rows = batch.select("x", "y").mapInArrow(run, "loss double, n long, g array<double>").collect()
    flat, out, at = np.sum([r.g for r in rows], axis=0), {}, 0
    for k in names:
        size = weights[k].size
        out[k], at = flat[at : at + size].reshape(weights[k].shape), at + size
    return sum(r.loss for r in rows), sum(r.n for r in rows), out


def scored(rows: DataFrame, weights: dict[str, np.ndarray], column: str = "x", out: str = "score") -> DataFrame:
    """Add `out`, the head's score of an array column; a column of that name is replaced."""
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for some in batches:
            x = np.array(some.column(column).to_pylist(), np.float64).reshape(some.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(Head.forward(weights, x)[0] if len(x) else [], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Trained:
    """The weights chosen, the checkpoints they come from, the log, and the last metrics."""

    weights: dict[str, np.ndarray]
    checkpoints: list[dict] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)
    final: dict = field(default_factory=dict)


def train(rows: DataFrame, plan: Plan, validate: Callable[[dict[str, np.ndarray]], dict], log_path: str | None = None) -> Trained:
    """Three phases; negatives weigh up to twice as much after a phase that leaves too many false positives.

    rows: cls, ord (dense from 0 in each class), x, y. validate: weights to fpph, recall and accuracy. In the last
    quarter of each phase every twentieth part of its steps is a checkpoint. The checkpoints within the best
    tenths of all three figures are averaged, or else the one of the best recall is taken.
    """
    spark = rows.sparkSession
    dim = len(rows.select("x").first()["x"])
    head, out = Head(dim, plan.hidden, plan.seed), Trained({})
    weight, done = plan.negative_weight, 0

    def note(entry: dict) -> None:
        out.log.append(entry)
        if log_path:
            append_metrics(spark, log_path, entry)

    for number, steps, rate in plan.phases:
        warmup, hold = (steps // 5, steps // 3) if number == 1 else (0, 0)
        optimiser, every = AdamW(head.weights, plan.decay), max(1, steps // 20)
        batches = dealt(rows, plan, number, steps) if steps else None
        for step in range(steps):
            negative = 1.0 + (weight - 1.0) * step / max(1, steps)
            _, n, gradient = summed_gradient(batches.where(F.col("batch") == step), head.weights, negative)
            optimiser.step({k: g / max(1, n) for k, g in gradient.items()}, rate_at(step, steps, warmup, hold, rate))
            if step >= steps * 3 // 4 and step % every == 0:
                found = validate(head.weights)
                note({"step": done + step, "phase": number, **found})
                out.checkpoints.append({"step": done + step, "phase": number, "weights": {k: v.copy() for k, v in head.weights.items()}, **found})
        done += steps
        found = validate(head.weights)
        note({"step": done, "phase": number, **found})
        if found["fpph"] > plan.target_fpph:
            weight *= 2
    out.weights = averaged(rows, out.checkpoints, head.weights)
    out.final = validate(out.weights)
    note({"step": done, "phase": 0, "note": "averaged", **out.final})
    return out


def averaged(rows: DataFrame, checkpoints: list[dict], last: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean weights of the checkpoints that percentile_filter keeps."""
    if not checkpoints:
        return last
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, float(c["recall"]), float(c["fpph"]), float(c["accuracy"])) for i, c in enumerate(checkpoints)], "step int, recall double, fpph double, accuracy double")
    kept = [r.step for r in metrics.percentile_filter(table).collect()] if len(checkpoints) > 1 else [0]
    return {k: np.mean([checkpoints[i]["weights"][k] for i in kept], axis=0) for k in last}


def train_verifier(rows: DataFrame, test: DataFrame, plan: Plan, target_recall: float = 0.9, average: int = 5, log_path: str | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """Weights and figures of a second-stage verifier: one phase, and the mean of the checkpoints that reject most near misses.

    rows: cls, ord, x, y; test: kind (positive, near_miss), x. From half of the steps on every twentieth part is a
    checkpoint, so is the last. The threshold is the highest that accepts the target share of the positives; without
    positive test clips it is 0.5. Of checkpoints that reject as many the later are taken.
    """
    spark = rows.sparkSession
    has_test = not test.where("kind = 'positive'").isEmpty()

    def validate(weights: dict[str, np.ndarray]) -> dict:
        if not has_test:
            return {"threshold": 0.5, "recall": 0.0, "near_miss_accept": 0.0, "near_miss_reject": 1.0}
        r = metrics.recall_threshold(scored(test, weights), [target_recall]).first()
        return {"threshold": r.threshold, "recall": r.recall, "near_miss_accept": r.near_miss_accept, "near_miss_reject": 1 - r.near_miss_accept}

    def note(entry: dict) -> None:
        if log_path:
            append_metrics(spark, log_path, entry)

    head = Head(len(rows.select("x").first()["x"]), plan.hidden, plan.seed)
    optimiser, steps, every = AdamW(head.weights, plan.decay), plan.steps, max(1, plan.steps // 20)
    batches, checkpoints = dealt(rows, plan, 1, steps), []
    for step in range(steps):
        _, n, gradient = summed_gradient(batches.where(F.col("batch") == step), head.weights, 1.0)
        optimiser.step({k: g / max(1, n) for k, g in gradient.items()}, rate_at(step, steps, steps // 10, steps // 3, plan.rate))
        if has_test and (step == steps - 1 or step >= steps // 2 and step % every == 0):
            found = validate(head.weights)
            note({"step": step, **found})
            checkpoints.append((found["near_miss_reject"], step, {k: v.copy() for k, v in head.weights.items()}))
    best = sorted(checkpoints, key=lambda c: c[:2])[-average:]
    weights = {k: np.mean([c[2][k] for c in best], axis=0) for k in head.weights} if best else head.weights
    final = validate(weights)
    note({"step": steps, "note": "averaged", **final})
    return weights, final
