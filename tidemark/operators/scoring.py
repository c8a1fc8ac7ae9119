"""Pluggable scorers: centroid, logistic regression, ONNX."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import signal

#: Rows of one call of a model.
BATCH = 1024


def score_with(rows: DataFrame, column: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "score", dtype: type = np.float32) -> DataFrame:
    """Add `out` by a model that is loaded once a task and called with (n, …) arrays of equal rows, of the type it takes.

    Rows whose array is null get null. A column `out` is replaced.
    """
    rows = rows.drop(out) if out != column else rows
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for batch in batches:
            values = batch.column(column).to_pylist()
            scores: list = [None] * len(values)
            good = [i for i, v in enumerate(values) if v is not None]
            for at in range(0, len(good), BATCH):
                some = good[at : at + BATCH]
                for i, s in zip(some, np.asarray(predict(np.array([values[i] for i in some], dtype))).reshape(-1)):
                    scores[i] = float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for a model file that every executor can read; one thread, fixed batch sizes filled up."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        entry = session.get_inputs()[0]
        fixed = entry.shape[0] if isinstance(entry.shape[0], int) else None

        def predict(x: np.ndarray) -> np.ndarray:
            if not fixed:
                return session.run(None, {entry.name: x})[0]
            parts = []
            for at in range(0, len(x), fixed):
                part = x[at : at + fixed]
                filled = np.concatenate([part, np.zeros((fixed - len(part), *part.shape[1:]), part.dtype)])
                parts.append(session.run(None, {entry.name: filled})[0][: len(part)])
            return np.concatenate(parts)

        return predict

    return load


@dataclass(frozen=True)
class Verifier:
    """A second-stage model and the threshold that was stored with it, 0.5 where none was."""

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    threshold: float = 0.5

    @classmethod
    def stored(cls, load: Callable, about: dict) -> Verifier:
        return cls(load, float(about.get("threshold", 0.5)))

    def score(self, rows: DataFrame, column: str, out: str = "verifier_score") -> DataFrame:
        return score_with(rows, column, self.load, out)

    def accepted(self, rows: DataFrame, column: str) -> DataFrame:
        """Add verifier_score and accepted."""
        return self.score(rows, column).withColumn("accepted", F.coalesce(F.col("verifier_score") >= self.threshold, F.lit(False)))


def centroid(rows: DataFrame, column: str) -> DataFrame:
    """One row: the mean vector, by element-wise partial sums."""
    flat = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("centroid"))


def centroid_scores(rows: DataFrame, column: str, centre: DataFrame) -> DataFrame:
    """Add score: a logistic of the inner product with the centroid (one row, sent to every task)."""
    return rows.join(F.broadcast(centre)).withColumn("score", signal.sigmoid(signal.dot(F.col(column), F.col("centroid")))).drop("centroid")


def train_logistic(rows: DataFrame, column: str, label: str, weight: str | None = None, steps: int = 50):
    """A Spark ML logistic regression on an array column; rows may carry a weight."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("__features", array_to_vector(F.col(column)))
    return LogisticRegression(featuresCol="__features", labelCol=label, maxIter=steps, regParam=0.01, **({"weightCol": weight} if weight else {})).fit(data)


def apply_logistic(model, rows: DataFrame, column: str) -> DataFrame:
    """Add score; all other columns pass, a column `score` is replaced."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    private = model.copy().setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("__probability").setPredictionCol("__prediction")
    scored = private.transform(rows.drop("score").withColumn("__features", array_to_vector(F.col(column))))
    return scored.withColumn("score", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability", "__prediction")


def train_hardening(rows: DataFrame, column: str, label: str, rounds: int = 3, target: float = 0.1):
    """Three rounds, each with the negatives' weight doubled while too many of them score over 0.5."""
    weight, model = 1.0, None
    for _ in range(rounds):
        weighted = rows.withColumn("__weight", F.when(F.col(label) < 0.5, F.lit(weight)).otherwise(F.lit(1.0)))
        model = train_logistic(weighted, column, label, "__weight")
        wrong = apply_logistic(model, rows.where(F.col(label) < 0.5), column).agg(F.avg((F.col("score") >= 0.5).cast("double"))).first()[0] or 0.0
        if wrong <= target:
            break
        weight *= 2
    return model
