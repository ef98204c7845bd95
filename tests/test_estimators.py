from __future__ import annotations

import itertools
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.fenwick import Fenwick
from panelspark.operators import inference, panels, walkforward
from panelspark.operators import estimators as est
from panelspark.sources import files


def test_temperature_is_recovered():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(20_000, 3)) * 2
    p = np.exp(z / 2.0)
    p /= p.sum(axis=1, keepdims=True)
    y = (p.cumsum(axis=1) > rng.random((len(z), 1))).argmax(axis=1)
    assert est.fit_temperature(z, y) == pytest.approx(2.0, rel=0.1)


def test_running_sums():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        x = rng.integers(0, 5, n)
        tree = Fenwick(x.tolist())
        for _ in range(50):
            i = int(rng.integers(n))
            x[i] += 2
            tree.add(i, 2)
            cum = np.cumsum(x)
            assert [tree.prefix(k) for k in range(n + 1)] == [0, *cum.tolist()]
            for t in rng.integers(0, cum[-1] + 1, 5).tolist():
                assert tree.find(t) == min(int(np.searchsorted(cum, t, side="right")), n - 1)


def test_online_conformal_covers_through_a_break(spark):
    rng = np.random.default_rng(1)
    scores = np.abs(np.concatenate([rng.normal(size=1500), 3 * rng.normal(size=1500)]))
    rows = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)] + [(1, 0, 1.0)], "k int, t int, s double").repartition(3)
    found = est.online_conformal(rows, "k", "t", "s", 0.1, 0.02, 50).orderBy("t").collect()
    assert len(found) == 2950 and found[0].level == 0.1
    assert np.mean([r.covered for r in found[1550:]]) == pytest.approx(0.9, abs=0.04)


def test_sequential_bootstrap_weighs_by_uniqueness():
    """Against weights made anew for each draw; labels of any lengths."""
    rng = np.random.default_rng(2)
    pos = np.sort(rng.choice(300, 120, replace=False))
    t1 = pos + rng.integers(0, 12, 120)
    numbers = [est.uniform(f"{i}") for i in range(200)]
    drawn, picks = np.zeros(400), []
    for u in numbers:
        w = np.array([(1 / (drawn[a : b + 1] + 1)).mean() for a, b in zip(pos, t1, strict=True)])
        picks.append(int(np.searchsorted(np.cumsum(w), u * w.sum(), side="right")))
        drawn[pos[picks[-1]] : t1[picks[-1]] + 1] += 1
    assert est.sequential_bootstrap(pos, t1, numbers) == picks
    crowded = est.sequential_bootstrap(np.arange(13), np.array([9] * 9 + [9, 10, 11, 12]), [est.uniform(f"x{i}") for i in range(400)])
    assert np.mean([d >= 10 for d in crowded]) > 3 / 13


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(200, 8))

    def plain(x, blocks):
        group = ((np.arange(len(x)) + 1) * blocks - 1) // len(x)
        sharpe = lambda r: r.mean(axis=0) / r.std(axis=0, ddof=1)
        below = []
        for chosen in itertools.combinations(range(blocks), blocks // 2):
            inside = np.isin(group, chosen)
            out = sharpe(x[~inside])
            below.append(((out < out[sharpe(x[inside]).argmax()]).sum() + 1) / (x.shape[1] + 1) <= 0.5)
        return np.mean(below), len(below)

    for x in (noise, noise + np.array([0.6] + [0.0] * 7)):
        rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
        found = inference.overfitting_probability(spark.createDataFrame(rows, "date int, s int, ret double"), "date", "s", "ret", 6).first()
        assert (found.pbo, found.splits) == pytest.approx(plain(x, 6)) and found.strategies == 8 and found.periods == 200


def test_resamples_are_blocks(spark):
    rows = inference.stationary_draws(spark, 50, 100, 10.0).groupBy("resample").agg({"times": "sum", "pos": "max"}).collect()
    assert len(rows) == 50 and all(r["sum(times)"] == 100 and r["max(pos)"] < 100 for r in rows)


def test_tests_of_many_models(spark):
    """A model that is better by far is found, noise alone is not."""
    rng = np.random.default_rng(5)
    for lift, low in ((0.5, True), (0.0, False)):
        f = rng.normal(size=(120, 6)) + np.array([lift] + [0.0] * 5)
        rows = [(i, j, float(v)) for i, r in enumerate(f) for j, v in enumerate(r)]
        df = spark.createDataFrame(rows, "date int, model int, f double")
        for studentised in (False, True):
            out = inference.best_of_many(df, "date", "model", "f", 100, 5.0, studentised).first()
            assert (out.p_value < 0.05) == low and out.n_models == 6 and out.n_periods == 120
            assert out.best_model == 0 if low else True


def test_signal_backtest_passes_over_what_costs_too_much():
    money, taken = est.signal_backtest(np.array([10.0, 10.0, 10.0]), np.array([11.0, 9.0, 12.0]), np.array([5.0, 50.0, 5.0]), np.array([1.0, 1.0, -1.0]), 100.0, 0.0, 0.0)
    assert taken.tolist() == [True, False, True] and money.tolist() == [105.0, 105.0, 95.0]


def paths(model, x):
    """Probability of each state at each time given all and given the past, by summing over every path."""
    k, n = len(model.start), len(x)
    like = np.exp(model.log_density(x))
    smoothed, filtered = np.zeros((n, k)), np.zeros((n, k))
    total = 0.0
    for path in itertools.product(range(k), repeat=n):
        p = model.start[path[0]] * like[0, path[0]]
        for t in range(1, n):
            p *= model.move[path[t - 1], path[t]] * like[t, path[t]]
        total += p
        for t, s in enumerate(path):
            smoothed[t, s] += p
    for t in range(n):
        for path in itertools.product(range(k), repeat=t + 1):
            p = model.start[path[0]] * like[0, path[0]]
            for i in range(1, t + 1):
                p *= model.move[path[i - 1], path[i]] * like[i, path[i]]
            filtered[t, path[-1]] += p
    return smoothed / total, filtered / filtered.sum(axis=1, keepdims=True), np.log(total)


def test_hidden_states_equal_sums_over_paths():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=300), rng.normal(size=300) ** 2])
    model = est.HiddenStates(3).fit(x)
    some = x[40:46]
    smoothed, filtered, total = paths(model, some)
    f, s, log_likelihood = model.posteriors(some)
    assert np.allclose(f, filtered, atol=1e-10) and np.allclose(s, smoothed, atol=1e-10) and log_likelihood == pytest.approx(total)


def test_hidden_states_find_the_turbulent_part():
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.normal(size=300), 5 * rng.normal(size=300), 2 * rng.normal(size=300)])
    x = np.column_stack([r, rng.normal(size=900)])
    model = est.HiddenStates(3).fit(x)
    size = [np.trace(c) for c in model.cov]
    assert size == sorted(size) and len(model.history) < 200 and all(b >= a - 1e-6 for a, b in itertools.pairwise(model.history))
    filtered, smoothed, _ = model.posteriors(x)
    assert smoothed[350:580, 2].mean() > 0.8 and smoothed[20:280, 0].mean() > 0.8
    assert np.allclose(model.posteriors(x[:400])[0], filtered[:400])  # no later value is read


def test_regimes_of_series(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(rng.normal()) if i != 7 else None) for k, n in ((0, 80), (1, 20)) for i in range(n)]
    found = est.regimes(spark.createDataFrame(rows, "k int, t int, r double"), "k", "t", "r").collect()
    assert len(found) == 79 and all(abs(sum(r.smoothed) - 1) < 1e-9 and r.filtered[r.state] == max(r.filtered) for r in found)


def test_event_backtest_waits_for_ten_and_stops_at_the_drawdown():
    rising = [100 * 1.01**i * (0.97 if i % 4 == 3 else 1) for i in range(120)]
    run = est.EventBacktest()
    rows = [run.step(2, 1.0, c) for c in rising]
    sized = [r["position"] for r in rows]
    assert sized[0] == 0 and sized[1] == 0  # even odds at first: nothing to win by Kelly's rule
    run = est.EventBacktest(prior=(0.6, 0.01, 0.01))
    falling = [run.step(2, 1.0, 100 * 0.7**i) for i in range(40)]
    assert falling[1]["position"] == pytest.approx(0.1) and falling[-1]["position"] == 0 and falling[-1]["equity"] == falling[-2]["equity"] < 0.86e6


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 10.0), ("B'", "2023-01-02", 1.0, 2.0, 0.5, 1.5, 0.0)], "ticker string, d string, open double, high double, low double, close double, volume double").select("ticker", F.to_date("d").alias("date"), "open", "high", "low", "close", "volume")
    df.write.option("header", True).csv(str(tmp_path / "p.csv"))
    assert [r.ticker for r in files.prices_csv(spark, str(tmp_path / "p.csv")).collect()] == ["A"]
    files.write_prices(df, str(tmp_path / "years"))
    assert spark.read.parquet(str(tmp_path / "years")).where("year = 2023").count() == 1
    files.write_sql(df, "bars", str(tmp_path / "sql"))
    assert any("('B''', '2023-01-02', 1.0" in r.value for r in spark.read.text(str(tmp_path / "sql")).collect())
    assert files.cached(spark, str(tmp_path / "cache"), lambda: df).count() == 2
    assert files.cached(spark, str(tmp_path / "cache"), lambda: df.limit(0)).count() == 2
    files.write_jsonl(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_factor_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("date,mkt,smb,other\n2024-01-02,0.01,0.002,5\n2024-01-03,-0.01,,5\n")
    assert files.factors_csv(spark, str(tmp_path / "f.csv")).columns == ["date", "MKT", "SMB"]
    (tmp_path / "g.csv").write_text("date,mkt\n2024-01-02,1.5\n2024-01-03,-2.0\n")
    with pytest.raises(ValueError):
        files.factors_csv(spark, str(tmp_path / "g.csv"))
    (tmp_path / "s.txt").write_text("Symbol|Name\nA|x\nA|x\nFile Creation Time: 1|\n")
    assert [r.Symbol for r in files.symbols(spark, str(tmp_path / "s.txt")).collect()] == ["A"]


def test_walk_forward_study(spark):
    """A feature that tells the class is found in every fold; no model sees a row of its later blocks."""
    rng = np.random.default_rng(7)
    rows = []
    for t in range(160):
        for k in range(6):
            y = int(rng.integers(0, 3))
            rows.append((t, k, float(y - 1 + rng.normal() * 0.8), float(rng.normal()), float((y - 1) * 0.01), y))
    panel = spark.createDataFrame(rows, "date int, ticker int, f1 double, f2 double, fwd_ret double, y int")
    folds = panels.walk_forward(panel.select("date").distinct(), 3, 0.01, 60, 20, 20)
    bounds = {r.fold: r for r in folds.collect()}

    def checked(inner):
        def fit(train, val, test, seed, fold):
            b = bounds[fold]
            assert train["date"].max() < b.train_hi <= b.val_lo - 3 and val["date"].min() >= b.val_lo and val["date"].max() < b.val_hi <= b.test_lo - 3 and test["date"].min() == b.test_lo
            return inner(train, val, test, seed, fold)

        return fit

    for model in (walkforward.logistic_model(["f1", "f2"]), walkforward.share_model("f1")):
        result = walkforward.study(panel, folds, checked(model), [0, 1])
        found = walkforward.fold_metrics(result).collect()
        assert {(r.fold, r.seed) for r in found} == {(f, s) for f in bounds for s in (0, 1)}
        assert np.mean([r.accuracy for r in found]) > 0.5 and np.mean([r.ic for r in found]) > 0.4
        assert np.mean([r.nll for r in found]) < np.log(3)
        covered = result.selectExpr("avg(cast(set_size = 3 OR p_down + p_neutral + p_up BETWEEN 0.999 AND 1.001 AS double)) AS c").first().c
        assert covered == 1.0


def test_vector_map_is_recovered():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(6000, 3)) * 2
    p = walkforward.softmax(z * [0.5, 1.0, 0.5] + [0.4, 0.0, -0.4])
    y = np.array([rng.choice(3, p=q) for q in p])
    scale, shift = walkforward.fit_vector(z, y, penalty=0.0)
    assert np.abs(walkforward.softmax(z * scale + shift) - p).mean() < 0.02
    assert walkforward.chosen_map(z, y)[0] != "none"
