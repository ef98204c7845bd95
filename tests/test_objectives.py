"""Objectives over all rows against sums over pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import objectives


def pairwise(c, r, width):
    d = c - r
    return np.sqrt(max((d[:, None] * d[None, :] * np.exp(-np.abs(c[:, None] - c[None, :]) / width)).sum() / len(c) ** 2, 1e-12))


@pytest.mark.parametrize("width", [0.4, 0.01, 0.0002])
def test_calibration_error_equals_pairs(spark, width):
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.random(400), np.full(300, 0.9), [0.0, 1.0]])  # a third are ties
    r = rng.random(len(c)) < c
    df = spark.createDataFrame([(float(x), bool(y)) for x, y in zip(c, r)] + [(None, True), (0.5, None)], "c double, r boolean").repartition(7)
    row = objectives.calibration_error(df, F.col("c"), F.col("r"), width).first()
    assert row.n == len(c) and row.mmce == pytest.approx(pairwise(c, r, width), rel=1e-9)


def test_calibration_error_of_few_rows(spark):
    one = spark.createDataFrame([(0.5, True)], "c double, r boolean")
    for df, n in ((one, 1), (one.limit(0), 0)):
        assert tuple(objectives.calibration_error(df, F.col("c"), F.col("r")).first()) == (0.0, n)


def test_soft_spearman_equals_pairs_and_splits_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(objectives, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.normal()), float(rng.integers(0, 9))) for g, n in ((0, 200), (1, 30), (2, 4), (None, 6)) for i in range(n)]
    df = spark.createDataFrame([*rows, (1, 99, None, 1.0), (1, 98, 0.0, None)], "g int, k int, s double, y double")
    rhos = []
    for g in (0, 1):
        part = [r for r in rows if r[0] == g]
        s, y = np.array([r[2] for r in part]), [(r[3], r[1]) for r in part]
        hard = np.argsort(np.argsort(np.array([v * 1000 + k for v, k in y])))
        soft = 1 + (1 / (1 + np.exp((s[:, None] - s[None, :]) / 0.1))).sum(axis=0)
        a, b = soft - soft.mean(), hard - hard.mean()
        rhos.append(a @ b / np.sqrt((a @ a) * (b @ b)))
    got = objectives.soft_spearman(df.where("g IS NOT NULL"), "g", "k", "s", "y", 0.1).first()
    assert got.n_groups == 2 and got.loss == pytest.approx(-np.mean(rhos), rel=1e-9)
    assert tuple(objectives.soft_spearman(df.limit(0), "g", "k", "s", "y").first()) == (0.0, 0)
