"""Linear classifiers by full gradients summed over partitions.

Objective: mean loss + |w|^2 / (2 n), the bias free, as libraries with a penalty of 1 have it. Losses: ``logistic`` and
``hinge`` (squared) are one binary problem for each class, all fitted side by side as columns of one matrix; ``softmax`` is one problem
over all classes. Solver: accelerated gradient steps from zero, w(k+1) = v - g(v) / L and v = w(k+1) + k / (k + 3) (w(k+1) - w(k)) for k = 0, 1 ..., where L bounds the
curvature by the mean of |x|^2 + 1 over the rows: a quarter of it for logistic, half for softmax, twice for hinge, and 1 / n more. A step is one pass over stored rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.plans.train import matrix, sum_over_tasks
from twinlens.session import stored

#: Curvature of a loss against the mean of |x|^2 + 1.
CURVATURE = {"logistic": 0.25, "softmax": 0.5, "hinge": 2.0}


@dataclass
class Linear:
    weights: np.ndarray  # (inputs + 1, classes), the bias last

    def predict(self, rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """``keep`` plus ``y_pred``: the class of the largest margin (to 9 digits), the lowest one on ties."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    w = shared.value
                    guess = np.round(matrix(b, "__v") @ w[:-1] + w[-1], 9).argmax(1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(guess.astype(np.int32))], [*b.schema.names[:-1], "y_pred"])

        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, f"{kept}, y_pred int")


def _slopes(loss: str, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivative of the loss of each row and class by its margin."""
    hot = np.zeros_like(z)
    hot[np.arange(len(z)), y] = 1.0
    if loss == "softmax":
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True) - hot
    if loss == "logistic":
        return 1.0 / (1.0 + np.exp(-z)) - hot
    side = 2 * hot - 1
    return -2.0 * side * np.maximum(0.0, 1.0 - side * z)


def read(batch: pa.RecordBatch) -> dict:
    return {"x": matrix(batch, "x"), "y": batch.column("y").to_numpy()}


def fit(train: DataFrame, vector: str, label: str, loss: str, steps: int = 100) -> Linear:
    """Trains on rows with a vector and a class number (0 ... C - 1), none of them null."""
    rows = stored(train.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")), "linear")
    squares = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(squares).alias("s"), F.max(F.size("x")).alias("d"), F.max("y").alias("c")).first()
    n, inputs, classes = size["n"], size["d"], size["c"] + 1
    curve = CURVATURE[loss] * (size["s"] + 1.0) + 1.0 / n
    w = v = np.zeros((inputs + 1, classes))
    for k in range(steps):
        shared = rows.sparkSession.sparkContext.broadcast(v)

        def slope(data, shared=shared):
            at = shared.value
            r = _slopes(loss, data["x"] @ at[:-1] + at[-1], data["y"])
            return {"g": np.vstack([data["x"].T @ r, r.sum(0)])}

        g = sum_over_tasks(rows, slope, {"g": w.shape}, read)["g"] / n
        g[:-1] += v[:-1] / n
        new = v - g / curve
        w, v = new, new + k / (k + 3) * (new - w)
        shared.destroy()
    return Linear(w)
