"""Boosted trees over relations against a fit in memory."""

from __future__ import annotations

import numpy as np
import pytest

from panelspark.operators import boosting
from panelspark.operators.boosting import UNIT, Settings


def in_memory(x, y, w, classes, s):
    """The same trees, node by node on whole arrays."""
    edges = []
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        edges.append(np.unique([v[max(int(np.ceil(i / s.bins * len(v))) - 1, 0)] for i in range(1, s.bins)]))
    bins = boosting.binned(x, edges)
    w = w / w.mean()
    scores = np.tile(np.log([max(w[y == k].sum() / w.sum(), 1e-9) for k in range(classes)]), (len(y), 1))
    for _ in range(s.rounds):
        g, h = boosting.gradients(scores, y, w)
        add = np.zeros_like(scores)
        for k in range(classes):

            def split(rows, depth):
                total_g, total_h = g[rows, k].sum(), h[rows, k].sum()
                worth = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + s.penalty)
                best = None
                if depth < s.depth:
                    for j in range(x.shape[1]):
                        for c in np.unique(bins[rows, j]):
                            left = rows[bins[rows, j] <= c]
                            n = len(left)
                            if n < s.least_rows or len(rows) - n < s.least_rows:
                                continue
                            lg, lh = g[left, k].sum(), h[left, k].sum()
                            gain = worth(lg, lh) + worth(total_g - lg, total_h - lh) - worth(total_g, total_h)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, j, c)
                if best is None:
                    add[rows, k] = -s.rate * (total_g / UNIT) / (total_h / UNIT + s.penalty)
                    return
                inside = bins[rows, best[1]] <= best[2]
                split(rows[inside], depth + 1)
                split(rows[~inside], depth + 1)

            split(np.arange(len(y)), 0)
        scores = scores + add
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def panel():
    rng = np.random.default_rng(4)
    rows = []
    for fold, n in ((0, 700), (1, 300)):
        x = rng.normal(size=(n, 3))
        x[rng.random((n, 3)) < 0.05] = np.nan
        y = (np.nan_to_num(x[:, 0]) + 0.5 * np.nan_to_num(x[:, 1]) ** 2 + 0.3 * rng.normal(size=n) > 0.3).astype(int) + (np.nan_to_num(x[:, 2]) > 1)
        for i in range(n):
            rows.append((fold, i, *[None if np.isnan(v) and i % 2 else float(v) for v in x[i]], int(y[i]), float(1 + i % 3)))
    return rows


@pytest.mark.parametrize("partitions", [1, 9])
def test_equal_to_a_fit_in_memory(spark, partitions, monkeypatch):
    monkeypatch.setattr(boosting, "PENDING", 2)  # the scores are written in between
    rows = panel()
    df = spark.createDataFrame(rows, "fold int, i int, a double, b double, c double, y int, w double").repartition(partitions)
    s = Settings(rounds=3, depth=3, rate=0.3, bins=12, least_rows=15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if partitions == 1 else 50)  # no fold fits a batch
    try:
        model = boosting.fit(df, "fold", ["a", "b", "c"], "y", "w", 3, s)
        found = {(r.fold, r.i): r.probabilities for r in boosting.predict(df, model, "fold").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for fold in (0, 1):
        part = [r for r in rows if r[0] == fold]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in part])
        y, w = np.array([r[5] for r in part]), np.array([r[6] for r in part])
        want = in_memory(x, y, w, 3, s)
        got = np.array([found[fold, r[1]] for r in part])
        assert np.allclose(got, want, atol=1e-9)
        assert (got.argmax(axis=1) == y).mean() > 0.75


def test_no_rows_and_one_class(spark):
    schema = "fold int, x double, y int"
    empty = boosting.fit(spark.createDataFrame([], schema), "fold", ["x"], "y", settings=Settings(rounds=2))
    assert boosting.predict(spark.createDataFrame([(0, 1.0, 0)], schema), empty, "fold").count() == 0
    one = spark.createDataFrame([(0, float(i), 1) for i in range(50)], schema)
    model = boosting.fit(one, "fold", ["x"], "y", settings=Settings(rounds=2))
    assert all(r.probabilities[1] > 0.99 for r in boosting.predict(one, model, "fold").collect())


def test_edges_are_exact_beyond_any_accuracy(spark):
    """Quantiles of more rows than percentile_approx keeps, and of bounds that miss them."""
    rows = spark.range(0, 400_000, 1, 7).selectExpr("cast(id % 2 as int) AS fold", "xxhash64(id) / 1e9 AS x0", "if(id % 3 = 0, double('nan'), cast(id % 5 as double)) AS x1", "cast(id % 3 as int) AS y")
    at = [i / 32 for i in range(1, 32)]
    values_ = rows.toPandas()
    for accuracy in (10_000, 100):
        found = boosting.quantiles(rows.select("fold", "x0", "x1"), 2, at, accuracy)
        for f in (0, 1):
            for j in (0, 1):
                v = np.sort(values_.loc[(values_.fold == f) & values_[f"x{j}"].notna(), f"x{j}"].to_numpy())
                assert found[f][j] == [v[int(np.ceil(q * len(v))) - 1] for q in at]
    model = boosting.fit(rows, "fold", ["x0", "x1"], "y", settings=Settings(rounds=1, depth=1, bins=32))
    assert all(list(model.edges[f][0]) == found[f][0] for f in (0, 1))
