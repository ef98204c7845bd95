"""Multinomial logistic regression of all folds at once, by Newton's steps from sums over rows.

Each step is one pass: tasks add up the gradient and the curvature of the rows they
read, a few hundred numbers a fold, Spark sums them over tasks, and the driver solves
the small system of each fold.  Rows never meet, so a fold may have any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


@dataclass
class Logistic:
    """By fold: means and deviations of the features, and weights [1 + features, classes], the first row the shift."""

    features: list[str]
    classes: int
    scale: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: dict[int, np.ndarray]


def design(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A column of ones and the scaled features; unknown values are the mean."""
    return np.column_stack([np.ones(len(x)), np.nan_to_num((x - scale[0]) / scale[1])])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted loss, gradient and curvature of rows, in one vector."""
    p = softmax(x @ weights)
    k, d = weights.shape[1], weights.shape[0]
    off = p - np.eye(k)[y]
    gradient = x.T @ (off * w[:, None])
    curve = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(k):
            curve[a, :, b, :] = (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    return np.concatenate([[loss, w.sum()], gradient.T.ravel(), curve.ravel()])


def fit(rows: DataFrame, fold: str, features: list[str], label: str, weight: str | None = None, classes: int = 3, penalty: float = 1e-3, rounds: int = 25, tolerance: float = 1e-9) -> Logistic:
    """Weights of least mean loss + penalty / 2 * their squares, for labels 0 to classes - 1; rows with a null label are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [f"x{j}" for j in range(len(features))]
    known = rows.where(F.col(label).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("y"), w.alias("w"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(n) for c, n in zip(features, names, strict=True)])
    known, read = files.written_at(known, "logistic")  # every step reads it
    found = known.groupBy("fold").agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).collect()  # a row a fold
    scale = {r["fold"]: (np.array([r[f"m_{n}"] or 0.0 for n in names]), np.maximum([r[f"s_{n}"] or 0.0 for n in names], 1e-8)) for r in found}
    size = 1 + len(features)
    model = Logistic(features, classes, scale, {f: np.zeros((size, classes)) for f in scale})
    open_, steps, last = set(scale), {f: np.zeros((size, classes)) for f in scale}, {f: np.inf for f in scale}
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        if not open_:
            break
        sent = sc.broadcast((scale, {f: model.weights[f] for f in open_}))

        def add_up(frames, sent=sent):
            scale_, weights = sent.value
            held: dict[int, np.ndarray] = {}
            for frame in frames:
                for f, part in frame.groupby("fold"):
                    if f in weights:
                        x = design(part[names].to_numpy(float), scale_[f])
                        held[f] = held.get(f, 0) + sums(x, part["y"].to_numpy(), part["w"].to_numpy(), weights[f])
            yield pd.DataFrame([(f, i, v) for f, total in held.items() for i, v in enumerate(total)], columns=["fold", "i", "v"])

        totals = known.mapInPandas(add_up, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v"))
        by_fold: dict[int, np.ndarray] = {f: np.zeros(2 + size * classes * (1 + size * classes)) for f in open_}
        for r in totals.collect():  # some hundred numbers a fold
            by_fold[r["fold"]][r["i"]] = r["v"]
        for f, total in by_fold.items():
            n, flat = total[1], model.weights[f].T.ravel()
            loss = total[0] / n + penalty / 2 * flat @ flat
            if loss > last[f] + 1e-12:  # too far: half of the step
                steps[f] = steps[f] / 2
                model.weights[f] = model.weights[f] - steps[f]
                continue
            last[f] = loss
            width = len(flat)
            gradient = total[2 : 2 + width] / n + penalty * flat
            curve = total[2 + width :].reshape(width, width) / n + penalty * np.eye(width)
            steps[f] = -np.linalg.solve(curve, gradient).reshape(classes, size).T
            model.weights[f] = model.weights[f] + steps[f]
            if np.abs(gradient).max() < tolerance:
                open_.discard(f)
    files.drop_folder(rows.sparkSession, read)
    return model


def predict(rows: DataFrame, model: Logistic, fold: str) -> DataFrame:
    """rows of the model's folds with ``probabilities``, one for each class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"_x{j}" for j in range(len(model.features))]
    folds = F.col(fold).isin([int(f) for f in model.scale]) if model.scale else F.lit(False)

    def run(frames):
        m = sent.value
        for frame in frames:
            for f, part in frame.groupby("_fold"):
                p = softmax(design(part[names].to_numpy(float), m.scale[f]) @ m.weights[f])
                yield part.drop(columns=["_fold", *names]).assign(probabilities=list(p))

    known = rows.where(folds).select("*", F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(n) for c, n in zip(model.features, names, strict=True)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return known.mapInPandas(run, f"{kinds}, probabilities array<double>")
