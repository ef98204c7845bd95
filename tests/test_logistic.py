"""Logistic regression from sums against gradient descent in memory."""

from __future__ import annotations

import numpy as np

from panelspark.operators import logistic


def descended(x, y, w, penalty, rounds=60_000, rate=0.8):
    k = np.eye(3)[y]
    weights = np.zeros((x.shape[1], 3))
    for _ in range(rounds):
        weights -= rate * (x.T @ ((logistic.softmax(x @ weights) - k) * w[:, None]) / w.sum() + penalty * weights)
    return weights


def test_weights_are_the_optimum_in_every_fold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for fold, n in ((0, 500), (3, 200)):
        x = rng.normal(size=(n, 5)) * [1, 2, 0.1, 5, 1] + [0, 1, 0, -3, 0]
        z = np.column_stack([x[:, 0], 0.3 * x[:, 1], -x[:, 2] + 0.1 * x[:, 3]])
        y = (z + rng.gumbel(size=z.shape)).argmax(axis=1)
        rows += [(fold, *map(float, v), int(c), float(1 + i % 2)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    names = list("abcde")
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double, e double, y int, w double")
    models = [logistic.fit(df.repartition(n), "fold", names, "y", "w", penalty=0.01) for n in (1, 7)]
    for fold in (0, 3):
        part = np.array([r for r in rows if r[0] == fold])
        x = logistic.design(part[:, 1:6], models[0].scale[fold])
        want = descended(x, part[:, 6].astype(int), part[:, 7], 0.01)
        for model in models:
            assert np.allclose(model.weights[fold], want, atol=1e-6)
    scored = logistic.predict(df, models[0], "fold").collect()
    assert len(scored) == 700 and np.mean([int(np.argmax(r.probabilities)) == r.y for r in scored]) > 0.5


def test_of_nothing_and_of_constant_features(spark):
    schema = "fold int, x double, y int"
    empty = logistic.fit(spark.createDataFrame([], schema), "fold", ["x"], "y")
    assert logistic.predict(spark.createDataFrame([(0, 1.0, 0)], schema), empty, "fold").count() == 0
    flat = logistic.fit(spark.createDataFrame([(0, 1.0, i % 4 == 0) for i in range(40)], "fold int, x double, y boolean"), "fold", ["x"], "y", penalty=1e-6)
    assert np.allclose(logistic.softmax(flat.weights[0][:1])[0], [0.75, 0.25, 0], atol=1e-3)


def test_rows_are_made_once_for_all_steps(spark):
    made = spark.sparkContext.accumulator(0)

    def build(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(300).selectExpr("0 AS fold", "sin(id) AS x", "cast(id % 3 as int) AS y").mapInArrow(build, "fold int, x double, y int")
    logistic.fit(rows, "fold", ["x"], "y")
    assert made.value == 300
