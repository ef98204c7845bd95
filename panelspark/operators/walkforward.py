"""Walk-forward study of one model: folds with purge and embargo, a model and a calibration each.

A fold with a seed is one group of a grouped map: its blocks of the panel are the
model's whole input, so folds run in parallel and no block goes to the driver.  A
fold must fit an executor, as the model's own matrices do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .estimators import fit_temperature

#: A caller's model: (train, validation, test, seed, fold) -> logits of both later blocks and an expected return of each test row.
FitPredict = Callable[[pd.DataFrame, pd.DataFrame, pd.DataFrame, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
BINS = 15


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = BINS) -> float:
    """Expected calibration error over equal-width bins of the confidence."""
    conf, hit = p.max(axis=1), p.argmax(axis=1) == y
    at = np.minimum((conf * bins).astype(int), bins - 1)
    return float(sum(abs(hit[at == b].sum() - conf[at == b].sum()) for b in np.unique(at)) / len(y))


def fit_vector(z: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 300, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """A positive scale and a shift of each class, drawn to 1 and 0, by gradient descent on the log-likelihood."""
    log_scale, shift, hot = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.eye(z.shape[1])[y]
    for _ in range(rounds):
        off = softmax(z * np.exp(log_scale) + shift) - hot
        log_scale -= rate * ((off * z * np.exp(log_scale)).mean(axis=0) + 2 * penalty * (np.exp(log_scale) - 1) * np.exp(log_scale))
        shift -= rate * (off.mean(axis=0) + 2 * penalty * shift)
    return np.exp(log_scale), shift


def chosen_map(z: np.ndarray, y: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Name, scales and shifts of the identity, temperature or vector map of least error on the later third of the validation block, on which none was fitted."""
    cut, one, zero = max(1, 2 * len(y) // 3), np.ones(z.shape[1]), np.zeros(z.shape[1])
    if len(y) - cut < 5:
        return "none", one, zero
    maps = [("none", one, zero), ("temperature", one / fit_temperature(z[:cut], y[:cut]), zero), ("vector", *fit_vector(z[:cut], y[:cut]))]
    return min(maps, key=lambda m: calibration_error(softmax(z[cut:] * m[1] + m[2]), y[cut:]))


def conformal_quantile(p: np.ndarray, y: np.ndarray, alpha: float) -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest score 1 - p of the true class, infinite where there are too few."""
    scores = np.sort(1 - p[np.arange(len(y)), y])
    k = int(np.ceil((len(y) + 1) * (1 - alpha)))
    return float(scores[k - 1]) if k <= len(scores) else float("inf")


def blocks(panel: DataFrame, folds: DataFrame, order: str) -> DataFrame:
    """Rows of the panel with ``fold`` and ``part``: train, val or test; rows between the blocks are purged.  folds as by ``panels.walk_forward``."""
    days = panel.select(order).distinct().withColumn("_pos", F.row_number().over(Window.orderBy(order)) - 1)
    inside = lambda name: (F.col("_pos") >= F.col(f"{name}_lo")) & (F.col("_pos") < F.col(f"{name}_hi"))
    part = F.when(inside("train"), "train").when(inside("val"), "val").when(inside("test"), "test")
    # a row a date and fold: dates are few, and each is in the folds by its own answer
    placed = days.crossJoin(F.broadcast(folds)).withColumn("part", part).where("part IS NOT NULL").select(order, "fold", "part")
    return panel.join(placed, order)


def study(panel: DataFrame, folds: DataFrame, model: FitPredict, seeds: list[int], key: str = "ticker", order: str = "date", label: str = "y", forward: str = "fwd_ret", alpha: float = 0.1) -> DataFrame:
    """(fold, seed, order, key, score, p_down, p_neutral, p_up, raw ones, calibrator, set_size, tradeable, y, forward) of every test row.

    Each model sees its training block only; the calibration map and the
    conformal quantile come from the validation block; the test block is predicted.
    ``set_size`` counts the classes of the prediction set (at least the likeliest),
    ``tradeable`` says that it is one.  A fold without a row in a block is left out.
    """
    kind = lambda c: panel.schema[c].dataType.simpleString()
    schema = f"fold int, seed int, {order} {kind(order)}, {key} {kind(key)}, score double, p_down double, p_neutral double, p_up double, raw_down double, raw_neutral double, raw_up double, calibrator string, set_size int, tradeable boolean, y int, {forward} double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    rows = blocks(panel.where(F.col(label).isNotNull()), folds, order).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([order, key], kind="stable")
        train, val, test = (part[part["part"] == x] for x in ("train", "val", "test"))
        if train.empty or val.empty or test.empty:
            return pd.DataFrame({c: [] for c in names})
        fold, seed = int(part["fold"].iloc[0]), int(part["seed"].iloc[0])
        z_val, z_test, score = model(train, val, test, seed, fold)
        y_val = val[label].to_numpy(int)
        name, scale, shift = chosen_map(z_val, y_val)
        p_val, p, raw = softmax(z_val * scale + shift), softmax(z_test * scale + shift), softmax(z_test)
        inside = (1 - p) <= conformal_quantile(p_val, y_val, alpha)
        inside[np.arange(len(p)), p.argmax(axis=1)] = True
        size = inside.sum(axis=1)
        columns = [np.full(len(p), fold), np.full(len(p), seed), test[order].to_numpy(), test[key].to_numpy(), score, *p.T, *raw.T, np.full(len(p), name), size, size == 1, test[label].to_numpy(int), test[forward].to_numpy(float)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return rows.groupBy("fold", "seed").applyInPandas(run, schema)


def fold_metrics(result: DataFrame, forward: str = "fwd_ret") -> DataFrame:
    """(fold, seed, n, accuracy, coverage, nll, raw_nll, mean set size) of a study."""
    best = F.array_position(F.array("p_down", "p_neutral", "p_up"), F.greatest("p_down", "p_neutral", "p_up")) - 1
    own = lambda p: F.element_at(F.array(*[f"{p}_{x}" for x in ("down", "neutral", "up")]), F.col("y") + 1)
    return result.groupBy("fold", "seed").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((best == F.col("y")).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(own("p"), F.lit(1e-12)))).alias("nll"),
        F.avg(-F.log(F.greatest(own("raw"), F.lit(1e-12)))).alias("raw_nll"),
        F.avg("set_size").alias("mean_set_size"),
        F.avg(F.col("tradeable").cast("double")).alias("singleton_rate"),
        F.corr("score", forward).alias("ic"),
    )


def block_metrics(scored: DataFrame, forward: str = "fwd_ret") -> DataFrame:
    """(fold, n, accuracy, nll, ic) of rows (fold, y, probabilities)."""
    p = F.col("probabilities")
    hit = F.array_position(p, F.array_max(p)) - 1 == F.col("y")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(p[F.col("y").cast("int")], F.lit(1e-12)))).alias("nll"), F.corr(p[2] - p[0], forward).alias("ic"))


# -- models -----------------------------------------------------------------


def share_model(feature: str) -> FitPredict:
    """Logits by the classes' shares among training rows of the same sign of a feature: a baseline without random numbers."""

    def fit(train: pd.DataFrame, val: pd.DataFrame, test: pd.DataFrame, seed: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = lambda part: (part[feature].to_numpy(float) > 0).astype(int)
        counts = np.ones((2, 3))
        np.add.at(counts, (side(train), train["y"].to_numpy(int)), 1)
        z = np.log(counts / counts.sum(axis=1, keepdims=True))
        p = softmax(z[side(test)])
        return z[side(val)], z[side(test)], p[:, 2] - p[:, 0]

    return fit


def logistic_model(features: list[str], rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> FitPredict:
    """Multinomial logistic regression of z-scored features by gradient descent; the scale is the training block's."""

    def fit(train: pd.DataFrame, val: pd.DataFrame, test: pd.DataFrame, seed: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = train[features].to_numpy(float)
        mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8)
        scaled = lambda part: np.column_stack([(part[features].to_numpy(float) - mean) / sd, np.ones(len(part))])
        x, y = scaled(train), np.eye(3)[train["y"].to_numpy(int)]
        w = np.random.default_rng(seed).normal(size=(x.shape[1], 3)) * 0.01
        for _ in range(rounds):
            w -= rate * (x.T @ (softmax(x @ w) - y) / len(x) + penalty * w)
        p = softmax(scaled(test) @ w)
        return scaled(val) @ w, scaled(test) @ w, p[:, 2] - p[:, 0]

    return fit
