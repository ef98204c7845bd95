from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import metric_search


def brute(rows, k, every):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = Counter()
    for n, (q, mine) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(mine))
            out.update((q, rank, i, max(-(2**63), min(-s, 2**63 - 1))) for rank, (s, i) in enumerate(scores[:k], 1))
    return out


def searched(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(4)
    return Counter(tuple(r) for r in metric_search.exact_top_k(table, k=5, every=50, **more).collect())


def normal(rng, n, size=6):
    return [(rng.normal(size=size) / 2).astype(np.float32).tolist() for _ in range(n)]


def test_exact_top_k(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(normal(rng, 600)))
    rows += [(600 + i, rows[0][1]) for i in range(100)]  # ties
    rows += [(0, rows[0][1]), (0, rows[0][1]), (50, rows[1][1]), (None, rows[2][1]), (701, None), (702, []), (703, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (704, [float("nan")] * 6), (705, [float("inf")] * 6), (750, [0.5, 0.25]), (751, [0.5, 0.25])]
    assert searched(spark, rows) == brute(rows, 5, 50)
    assert searched(spark, []) == Counter()


def test_rows_that_repeat_count_each(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(normal(rng, 400)))
    nearest = [8 * x for x in rows[50][1]]
    rows += [(1001, nearest)] * 12  # more than k copies of the nearest row
    rows += [(1002, [x + n / 64 for x in nearest]) for n in range(40)]  # several near vectors of one id
    rows += [(100, rows[100][1])] * 7  # copies of a query are partners of each other
    assert searched(spark, rows) == brute(rows, 5, 50)


@pytest.mark.parametrize("high", [7e4, 1e6, 1e9, 1e30])
def test_large_components(spark, high):
    rng = np.random.default_rng(7)
    rows = [(i, [x * high for x in v] if i % 3 else v) for i, v in enumerate(normal(rng, 300))]
    rows += [(300 + i, [high * (1 + i * 1e-7), 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)]  # near ties
    assert searched(spark, rows) == brute(rows, 5, 50)


def test_many_groups_and_blocks(spark, monkeypatch):
    for name, value in (("GROUP_ROWS", 60), ("BLOCK_QUERIES", 5), ("PAGE", 8), ("FANOUT", 4), ("SAMPLE_ROWS", 200)):
        monkeypatch.setattr(metric_search, name, value)
    rng = np.random.default_rng(9)
    rows = list(enumerate(normal(rng, 500, 3))) + [(500 + i, [0.25, 0.5, 0.75]) for i in range(300)]  # one vector of a third of the rows
    assert searched(spark, rows) == brute(rows, 5, 50)


def test_tree_passes_over_entries():
    """On clustered vectors the tree computes a small share of the entries; results are those of a scan."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16)) * 2
    x = np.floor(256 * (centers[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) / 20))
    ids = np.arange(8000)
    search = metric_search.Search(metric_search.build(x, ids, np.ones(8000, np.int64)), 5)
    asked = range(0, 8000, 100)
    for q in asked:
        score = x @ x[q]
        order = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:5]
        assert search.top(x[q], q) == [(int(-s), i) for s, i in order]
    assert search.computed < 0.3 * len(x) * len(asked)
