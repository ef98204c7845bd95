"""Closed forms of sizing, costs and calibration, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def kelly(mu: Column, sigma2: Column) -> Column:
    """mu / sigma2, the variance at least 1e-12."""
    return mu / F.greatest(sigma2, F.lit(1e-12))


def fractional_kelly(mu: Column, sigma2: Column, kappa: float, most: float) -> Column:
    return clip(kappa * kelly(mu, sigma2), -most, most)


def log_growth(f: Column, mu: Column, sigma2: Column) -> Column:
    return f * mu - 0.5 * f * f * sigma2


def growth_from_variance_ratio(u: Column) -> Column:
    """Share of the best growth kept when the variance is wrong by the ratio u."""
    return 2 * u - u * u


def binary_kelly(p: Column, b: float) -> Column:
    return p - (1 - p) / b


def half_kelly_long_only(p: Column, gain: float, loss: float, scale: float) -> Column:
    return clip(scale * (p / loss - (1 - p) / gain), 0.0, 1.0)


def cost_rate(notional: Column, adv: Column, vol: Column, half_spread: float, eta: float) -> Column:
    """Half spread plus impact that grows with the root of participation."""
    return half_spread + eta * vol * F.sqrt(notional / F.nullif(adv, F.lit(0.0)))


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    high = F.greatest(*logits)
    e = [F.exp((z - high) / temperature) for z in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def argmax(columns: list[Column]) -> Column:
    """Place of the largest, the first of several."""
    a = F.array(*columns)
    return F.array_position(a, F.array_max(a)) - 1
