"""Portfolio solvers against random feasible weights and optimality conditions."""

from __future__ import annotations

import numpy as np
import pytest

from panelspark.operators import portfolios as pf
from panelspark.operators.convex import solve


def problems(n=12, rounds=40):
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        x = rng.normal(size=(80, n)) * rng.uniform(0.005, 0.05, n) @ (np.eye(n) + 0.3 * rng.normal(size=(n, n)) / np.sqrt(n)) + rng.normal(size=n) * 0.003
        yield rng, x, x.mean(axis=0), np.cov(x.T)


def capped(rng, n, cap, count=3000):
    """Random weights from 0 to the cap that sum to 1, corners among them."""
    out = []
    for w in rng.dirichlet(np.full(n, 0.7), count):
        for _ in range(50):
            over = np.maximum(w - cap, 0).sum()
            if over < 1e-15:
                break
            w = np.minimum(w, cap)
            room = cap - w
            w = w + over * room / room.sum()
        out.append(w)
    return np.array(out)


def test_solver_agrees_with_closed_forms():
    q = np.array([[2.0, 0.5], [0.5, 1.0]])
    none = solve(q, np.array([1.0, 1.0]), np.zeros((1, 2)), np.ones(1))
    assert np.allclose(none.x, np.linalg.solve(q, [-1, -1]), atol=1e-8) and none.residual < 1e-8
    corner = solve(np.zeros((2, 2)), np.array([-1.0, -2.0]), np.vstack([-np.eye(2), np.ones((1, 2))]), np.array([0.0, 0.0, 1.0]))
    assert np.allclose(corner.x, [0, 1], atol=1e-8) and corner.gap < 1e-8


@pytest.mark.parametrize("cap", [0.1, 0.25, 1.0])
def test_maximum_sharpe_is_not_beaten(cap):
    solved = 0
    for rng, _, mu, cov in problems():
        s = pf.maximum_sharpe(mu, cov, cap=cap)
        assert s.x.sum() == pytest.approx(1) and s.x.min() >= -1e-9 and s.x.max() <= max(cap, 1 / 12) + 1e-9
        if not np.isfinite(s.residual):
            continue
        solved += 1
        assert s.residual < 1e-8 and s.gap < 1e-8
        ratio = lambda w: w @ mu / np.sqrt(np.einsum("...i,ij,...j->...", w, cov, w))
        others = capped(rng, 12, max(cap, 1 / 12))
        near = np.clip(s.x + 0.02 * rng.normal(size=(500, 12)), 0, cap)
        near = near[np.abs(near.sum(axis=1)) > 0]
        near = near / near.sum(axis=1, keepdims=True)
        near = near[near.max(axis=1) <= cap]
        assert ratio(s.x) >= max(ratio(others).max(), ratio(near).max() if len(near) else -np.inf) - 1e-9
    assert solved > 25


def test_maximum_sharpe_without_excess():
    s = pf.maximum_sharpe(np.array([-0.3, -0.1, -0.2]), np.eye(3), cap=0.5)
    assert np.allclose(s.x, [0, 0.5, 0.5]) and not np.isfinite(s.residual)


def test_minimum_variance_is_not_beaten():
    for rng, _, _, cov in problems(rounds=15):
        s = pf.minimum_variance(cov, 0.3)
        risk = lambda w: np.einsum("...i,ij,...j->...", w, cov, w)
        assert s.residual < 1e-8 and risk(s.x) <= risk(capped(rng, 12, 0.3)).min() + 1e-15


def test_mean_variance_meets_its_constraints_and_conditions():
    for rng, _, mu, cov in problems(rounds=15):
        before = rng.normal(size=12) * 0.02
        for turnover in (0.0, 0.0005):
            s = pf.mean_variance(mu, cov, cap=0.1, leverage=0.6, turnover=turnover, before=before)
            gain = lambda w: w @ mu - 2.5 * np.einsum("...i,ij,...j->...", w, cov, w) - turnover * np.abs(w - before).sum(axis=-1)
            assert abs(s.x.sum()) < 1e-8 and np.abs(s.x).max() <= 0.1 + 1e-8 and np.abs(s.x).sum() <= 0.6 + 1e-8 and s.residual < 1e-8
            near = s.x + rng.normal(size=(4000, 12)) * rng.choice([1e-4, 1e-2, 0.1], (4000, 1))
            near = near - near.mean(axis=1, keepdims=True)
            near = near / np.maximum(1, np.maximum(np.abs(near).max(axis=1) / 0.1, np.abs(near).sum(axis=1) / 0.6))[:, None]
            assert gain(s.x) >= gain(near).max() - 1e-9
    held = pf.mean_variance(mu, cov, turnover=10.0, before=np.array([0.1, -0.1] + [0.0] * 10))
    assert np.allclose(held.x, [0.1, -0.1] + [0.0] * 10, atol=1e-7)


def test_least_shortfall_closes_its_gap():
    for rng, x, mu, _ in problems(rounds=8):
        for target in (None, 0.0005):
            s = pf.least_shortfall(x, 0.9, cap=0.2, leverage=1.0, target=target)
            if target is not None and s.residual > 1e-6:
                continue  # no weights earn so much
            assert abs(s.x.sum()) < 1e-7 and np.abs(s.x).max() <= 0.2 + 1e-7 and np.abs(s.x).sum() <= 1 + 1e-7
            assert s.gap < 1e-6 and s.residual < 1e-8
            assert target is None or s.x @ mu >= target - 1e-8
        s = pf.least_shortfall(x, 0.9, cap=0.4, leverage=1.0, neutral=False, long_only=True)
        assert s.gap < 1e-6 and pf.shortfall(x, s.x, 0.9) <= min(pf.shortfall(x, w, 0.9) for w in capped(rng, 12, 0.4)) + 1e-9


def test_risk_parity_has_equal_shares():
    for _, _, _, cov in problems(rounds=10):
        w = pf.risk_parity(cov)
        risk = w * (cov @ w)
        assert w.sum() == pytest.approx(1) and w.min() > 0 and np.allclose(risk, risk.mean(), rtol=1e-9)


def test_views_move_the_prior():
    cov = np.diag([1.0, 4.0, 9.0])
    p = np.array([[1.0, 0, 0]])
    prior = 2.5 * cov @ np.full(3, 1 / 3)
    sure, unsure = (pf.black_litterman(cov, np.full(3, 1 / 3), p, np.array([9.0]), confidence=np.array([c])) for c in (0.9, 0.1))
    assert prior[0] < unsure[0] < sure[0] < 9 and np.allclose(sure[1:], prior[1:])


def test_moments_are_those_of_complete_names(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    rows = [(g, t, i, float(x[t, i] * (g + 1))) for g in (0, 1) for t in range(50) for i in range(4) if not (g == 1 and i == 2 and t == 7)]
    df = spark.createDataFrame(rows, "yr int, date int, ticker int, ret double").repartition(6)
    for row in pf.moments(df, "yr", "date", "ticker", "ret").collect():
        names = [0, 1, 2, 3] if row.yr == 0 else [0, 1, 3]
        part = x[:, names] * (row.yr + 1)
        assert row.names == names and row.n == 50 and np.allclose(row["mean"], part.mean(axis=0))
        assert np.allclose(np.array(row["cov"]), np.cov(part.T, bias=True))
        cov, share = pf.shrunk(np.array(row["cov"]), row.n, row.fourth)
        c = part - part.mean(axis=0)
        k, s = len(names), c.T @ c / 50
        noise = sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / (50**2 * k)
        assert share == pytest.approx(min(noise / (((s - np.trace(s) / k * np.eye(k)) ** 2).sum() / k), 1)) and np.allclose(cov, cov.T)
