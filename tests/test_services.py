"""Projections, request keys and provider payloads against plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import panels
from panelspark.operators.convex import box, solve
from panelspark.sources import providers


def test_projection_is_the_nearest_neutral_point(spark):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=15), 1: np.full(4, 0.3), 2: np.array([5.0, -0.01, 0.0, 0.02]), 3: np.array([1.0]), 4: np.concatenate([np.ones(9), -np.ones(3)])}
    rows = [(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)]
    found = {}
    for r in panels.neutral_projection(spark.createDataFrame(rows, "g int, i int, x double").repartition(5), "g", "x", 0.1).collect():
        found.setdefault(r.g, {})[r.i] = r.weight
    for g, x in groups.items():
        got = np.array([found[g][i] for i in range(len(x))])
        want = solve(np.eye(len(x)), -x, *box(len(x), -0.1, 0.1), np.ones((1, len(x))), np.zeros(1)).x
        assert abs(got.sum()) < 1e-9 and np.allclose(got, want, atol=1e-6), g


def test_requests_go_to_keys_in_turn(spark):
    rows = [(day, i) for day, n in ((1, 5), (2, 9), (3, 2)) for i in range(n)]
    got = {(r.day, r.i): r.key_index for r in panels.dealt_to_keys(spark.createDataFrame(rows, "day int, i int").repartition(3), "day", ["i"], 3, 2).collect()}
    given, want = 0, {}
    for day, n in ((1, 5), (2, 9), (3, 2)):
        for i in range(n):
            want[day, i] = given % 3 + 1 if i < 6 else None
            given += i < 6
    assert got == want


def test_payloads_of_providers(spark):
    rows = [
        ("fmp", '{"symbol": "A", "price": 10, "change": 1, "changesPercentage": 11.1, "volume": 5}', (10.0, 1.0, 11.1, 5.0)),
        ("finnhub", '{"c": 9, "d": -1, "dp": -10, "pc": 10}', (9.0, -1.0, -10.0, None)),
        ("finnhub", '{"c": 9, "pc": 10}', (9.0, -1.0, -10.0, None)),
        ("yahoo", '{"lastPrice": 11, "previousClose": 10, "lastVolume": 7}', (11.0, 1.0, 10.0, 7.0)),
        ("yahoo", '{"lastPrice": 11, "previousClose": 0}', (11.0, 11.0, None, None)),
        ("fmp", '{"price": 0}', None), ("fmp", "{broken", None), ("nobody", '{"price": 3}', None), ("fmp", None, None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "i int, p string, t string")
    for r in df.select("i", providers.quote(F.col("p"), F.col("t")).alias("q")).collect():
        want = rows[r.i][2]
        assert (r.q is None) == (want is None) and (want is None or tuple(r.q) == pytest.approx(want)), r
    markets = spark.createDataFrame([("nse ", "INR"), ("LSE", "GBP"), ("NYSE", "USD"), (None, "USD")], "m string, c string")
    assert all(r.found == r.c for r in markets.select("c", providers.currency(F.col("m")).alias("found")).collect())
