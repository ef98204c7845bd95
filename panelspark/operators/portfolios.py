"""Portfolios: moments of returns as relations, and the weights that solve each problem exactly.

Means and covariances are sums over dates, made by Spark: tasks add up outer products
of the dates they read, and only sums are shuffled.  What a solver gets is one row a
group, as large as the square of its names.  The least shortfall needs the scenarios
themselves, a group of dates by names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .convex import Solution, box, solve

#: Numbers of the sums that a task holds before it sends them on.
HELD = 1 << 22


# -- moments ----------------------------------------------------------------

def complete(panel: DataFrame, by: str, order: str, ticker: str, ret: str) -> DataFrame:
    """The rows of the names that have a value on all dates of their group."""
    rows = panel.where(F.col(ret).isNotNull() & ~F.isnan(F.col(ret).cast("double"))).select(by, order, ticker, F.col(ret).cast("double").alias(ret))
    days = rows.groupBy(by).agg(F.countDistinct(order).alias("_days"))
    return rows.join(days, by).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by, ticker))).where("_n = _days").drop("_n", "_days")


def moments(panel: DataFrame, by: str, order: str, ticker: str, ret: str) -> DataFrame:
    """(by, n, names, mean, cov, fourth): of each group's complete names, in ascending order; cov by n; fourth: sum of squared squared lengths of the centred vectors."""
    rows = complete(panel, by, order, ticker, ret)
    mean = F.avg(ret).over(Window.partitionBy(by, ticker))
    centred = rows.withColumn("_mean", mean).withColumn("_x", F.col(ret) - F.col("_mean"))
    vectors = centred.groupBy(by, order).agg(F.sort_array(F.collect_list(F.struct(F.col(ticker).alias("t"), F.col("_x").alias("x")))).alias("v"))
    kind = panel.schema[by].dataType.simpleString()

    def add_up(frames):
        held: dict = {}

        def flush():
            out = [(key, i, n if i == 0 else 0, fourth if i == 0 else 0.0, row.tolist()) for key, (n, fourth, total) in held.items() for i, row in enumerate(total)]
            held.clear()
            return pd.DataFrame(out, columns=[by, "i", "n", "fourth", "sums"])

        for frame in frames:
            for key, part in frame.groupby(by, dropna=False):
                x = np.array(part["x"].tolist(), dtype=float)
                n, fourth, total = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(x), fourth + float(((x**2).sum(axis=1) ** 2).sum()), total + x.T @ x)
            if sum(t[2].size for t in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    sums = vectors.select(by, F.transform("v", lambda p: p["x"]).alias("x")).mapInPandas(add_up, f"{by} {kind}, i int, n long, fourth double, sums array<double>")
    cells = sums.select(by, "i", "n", "fourth", F.posexplode("sums").alias("j", "s")).groupBy(by, "i", "j").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("j") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("j") == 0, F.col("fourth"))).alias("fourth"))
    lines = cells.groupBy(by, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda p: p["s"]).alias("line"), F.sum("n").alias("n"), F.sum("fourth").alias("fourth"))
    whole = lines.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda p: p["line"]).alias("sums"), F.sum("n").alias("n"), F.sum("fourth").alias("fourth"))
    means = rows.groupBy(by, ticker).agg(F.avg(ret).alias("m")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(ticker).alias("t"), "m"))).alias("_m"))
    cov = F.transform("sums", lambda line: F.transform(line, lambda s: s / F.col("n")))
    return whole.join(means, by).select(by, "n", F.transform("_m", lambda p: p["t"]).alias("names"), F.transform("_m", lambda p: p["m"]).alias("mean"), cov.alias("cov"), "fourth")


def shrunk(cov: np.ndarray, n: int, fourth: float) -> tuple[np.ndarray, float]:
    """Covariance moved towards a multiple of the identity, and by which share (Ledoit and Wolf), from the sums alone."""
    k = len(cov)
    level = np.trace(cov) / k
    far = ((cov - level * np.eye(k)) ** 2).sum() / k
    noise = max(fourth / n - (cov**2).sum(), 0.0) / (n * k)
    share = float(min(noise / far, 1.0)) if far > 0 else 0.0
    return share * level * np.eye(k) + (1 - share) * cov, share


# -- weights ----------------------------------------------------------------

def invested(k: int, cap: float) -> tuple[np.ndarray, np.ndarray, float]:
    """g, h of weights from 0 to the cap, which is raised where all of it would not make 1."""
    cap = max(cap, 1 / k)
    return *box(k, 0.0, cap), cap


def minimum_variance(cov: np.ndarray, cap: float = 1.0) -> Solution:
    """Least variance of weights from 0 to the cap that sum to 1."""
    g, h, _ = invested(len(cov), cap)
    return solve(cov, np.zeros(len(cov)), g, h, np.ones((1, len(cov))), np.ones(1))


def highest_return(mu: np.ndarray, cap: float) -> np.ndarray:
    """Weights from 0 to the cap with sum 1 of the highest mean: the best names, filled up."""
    w, left = np.zeros(len(mu)), 1.0
    for i in np.argsort(-mu, kind="stable"):
        w[i] = min(cap, left)
        left -= w[i]
    return w


def maximum_sharpe(mu: np.ndarray, cov: np.ndarray, rate: float = 0.0, cap: float = 0.1) -> Solution:
    """Highest (w'mu - rate) / sqrt(w'cov w) of weights from 0 to the cap that sum to 1.

    The ratio does not change with the size of w, so it is the least variance of vectors
    of excess 1, with their sum as a variable.  Where no weights have a positive excess
    the ratio has no such form; the weights of the highest mean are returned, with an
    infinite residual.
    """
    k = len(mu)
    cap = max(cap, 1 / k)
    excess = mu - rate
    highest = highest_return(excess, cap)
    if highest @ excess <= 1e-14 * np.abs(excess).max(initial=0) or not np.any(excess):
        return Solution(highest, np.inf, np.inf)
    scale = highest @ excess
    q = np.zeros((k + 1, k + 1))
    q[:k, :k] = cov
    # 0 <= y <= cap * total, excess'y = scale, sum y = total
    g = np.vstack([np.hstack([-np.eye(k), np.zeros((k, 1))]), np.hstack([np.eye(k), np.full((k, 1), -cap)])])
    a = np.vstack([np.append(excess / scale, 0.0), np.append(np.ones(k), -1.0)])
    found = solve(q, np.zeros(k + 1), g, np.zeros(2 * k), a, np.array([1.0, 0.0]))
    return Solution(found.x[:k] / found.x[k], found.gap, found.residual)


def mean_variance(mu: np.ndarray, cov: np.ndarray, cap: float = 0.1, leverage: float = 2.0, aversion: float = 5.0, turnover: float = 0.0, before: np.ndarray | None = None, neutral: bool = True, long_only: bool = False) -> Solution:
    """Highest mu'w - aversion / 2 w'cov w - turnover |w - before| of weights within the cap; neutral: they sum to 0; their sizes sum to the leverage at most."""
    k = len(mu)
    before = np.zeros(k) if before is None else before
    # w = p - m with p, m >= 0, and t >= |w - before|
    split = np.hstack([np.eye(k), -np.eye(k)])
    extra = k if turnover > 0 else 0
    wide = lambda rows: np.hstack([rows, np.zeros((len(rows), extra))])
    g = [wide(-np.eye(2 * k)), wide(split), wide(-split), wide(np.ones((1, 2 * k)))]
    h = [np.zeros(2 * k), np.full(k, cap), np.full(k, 0.0 if long_only else cap), np.array([leverage])]
    c = np.concatenate([-mu, mu, np.full(extra, turnover)])
    if extra:
        g += [np.hstack([split, -np.eye(k)]), np.hstack([-split, -np.eye(k)])]
        h += [before, -before]
    q = np.zeros((2 * k + extra, 2 * k + extra))
    q[: 2 * k, : 2 * k] = aversion * split.T @ cov @ split
    a = wide(split.sum(axis=0)[None, :]) if neutral else None
    found = solve(q, c, np.vstack(g), np.concatenate(h), a, np.zeros(1) if neutral else None)
    return Solution(split @ found.x[: 2 * k], found.gap, found.residual)


def least_shortfall(returns: np.ndarray, alpha: float = 0.95, cap: float = 0.1, leverage: float = 2.0, target: float | None = None, neutral: bool = True, long_only: bool = False) -> Solution:
    """Least expected shortfall over the scenarios (rows), a linear program.

    Weights lie within the cap, sum to 0 if neutral and else to 1, their sizes to the
    leverage at most; ``target``: least mean.  The shortfall is the least level + mean
    excess of losses over it / (1 - alpha).
    """
    n, k = returns.shape
    size = np.abs(returns).max(initial=0) or 1.0
    r = returns / size
    # variables: p, m (w = p - m), the level, and each scenario's excess
    split = np.hstack([np.eye(k), -np.eye(k)])
    wide = lambda rows, level=0.0: np.hstack([rows, np.full((len(rows), 1), level), np.zeros((len(rows), n))])
    over = np.hstack([-r @ split, -np.ones((n, 1)), -np.eye(n)])
    g = [over, np.hstack([np.zeros((n, 2 * k + 1)), -np.eye(n)]), wide(-np.eye(2 * k)), wide(split), wide(-split), wide(np.ones((1, 2 * k)))]
    h = [np.zeros(n), np.zeros(n), np.zeros(2 * k), np.full(k, cap), np.full(k, 0.0 if long_only else cap), np.array([leverage])]
    if target is not None:
        g.append(wide(-(r.mean(axis=0) @ split)[None, :]))
        h.append(np.array([-target / size]))
    c = np.concatenate([np.zeros(2 * k), [1.0], np.full(n, 1 / ((1 - alpha) * n))])
    found = solve(np.zeros((len(c), len(c))), c, np.vstack(g), np.concatenate(h), wide(split.sum(axis=0)[None, :]), np.array([0.0 if neutral else 1.0]))
    return Solution(split @ found.x[: 2 * k], found.gap, found.residual)


def shortfall(returns: np.ndarray, w: np.ndarray, alpha: float = 0.95) -> float:
    """Mean of the worst (1 - alpha) of losses, the last scenario in part."""
    loss = np.sort(-(returns @ w))[::-1]
    tail = (1 - alpha) * len(loss)
    full = int(tail)
    rest = loss[full] * (tail - full) if full < len(loss) else 0.0
    return float((loss[:full].sum() + rest) / tail)


def risk_parity(cov: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Weights of equal risk shares that sum to 1.

    They minimise w'cov w / 2 - mean(log w), a coordinate at a time: each is the positive
    root of its own quadratic equation.
    """
    k = len(cov)
    own = np.diag(cov)
    w = 1 / np.sqrt(own)
    for _ in range(sweeps):
        last = w.copy()
        for i in range(k):
            others = cov[i] @ w - own[i] * w[i]
            w[i] = (np.sqrt(others * others + 4 * own[i] / k) - others) / (2 * own[i])
        if np.abs(w - last).max() <= 1e-15 * w.max():
            break
    return w / w.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, delta: float = 2.5, tau: float = 0.05, confidence: np.ndarray | None = None) -> np.ndarray:
    """Posterior expected returns of views p r = q; the surer a view (confidence 0 to 1), the less its variance."""
    prior = delta * cov @ market
    spread = np.diag(p @ (tau * cov) @ p.T)
    omega = np.diag(spread if confidence is None else spread * (1 - np.clip(confidence, 0.1, 0.9)))
    gain = tau * cov @ p.T @ np.linalg.inv(p @ (tau * cov) @ p.T + omega)
    return prior + gain @ (q - p @ prior)


# -- as relations -----------------------------------------------------------

KINDS = ("min_var", "parity", "max_sharpe", "mean_var", "views")


def portfolio_weights(panel: DataFrame, by: str, order: str, ticker: str, ret: str, cap: float = 0.1) -> DataFrame:
    """(by, kind, ticker, weight, gap, residual, shrinkage) of each group with three dates and two names, on shrunk covariances.

    ``views``: mean-variance weights after the view that the best name so far keeps half
    of its lead.  Parity has no gap; its residual is the largest distance of a risk share from the mean.
    """
    kind, name = (panel.schema[c].dataType.simpleString() for c in (by, ticker))
    schema = f"{by} {kind}, kind string, {ticker} {name}, weight double, gap double, residual double, shrinkage double"

    def weights(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                cov, share = shrunk(np.array([list(x) for x in row.cov]), row.n, row.fourth)
                mu, k = np.array(row.mean), len(row.mean)
                view = np.zeros((1, k))
                view[0, mu.argmax()] = 1.0
                posterior = black_litterman(cov, np.full(k, 1 / k), view, np.array([mu.max() / 2]))
                parity = risk_parity(cov)
                risk = parity * (cov @ parity)
                found = (minimum_variance(cov, cap), Solution(parity, 0.0, float(np.abs(risk / risk.sum() - 1 / k).max())), maximum_sharpe(mu, cov, cap=cap), mean_variance(mu, cov, cap), mean_variance(posterior, cov, cap))
                for which, s in zip(KINDS, found, strict=True):
                    yield pd.DataFrame({by: [row[0]] * k, "kind": which, ticker: list(row.names), "weight": s.x, "gap": s.gap, "residual": s.residual, "shrinkage": share})

    known = moments(panel, by, order, ticker, ret).where((F.col("n") >= 3) & (F.size("names") >= 2))
    return known.select(by, "n", "names", "mean", "cov", "fourth").mapInPandas(weights, schema)


def parity_weights(panel: DataFrame, by: str, order: str, ticker: str, ret: str) -> DataFrame:
    """(by, ticker, weight, risk) of equal risk on sample covariances; risk: a name's part of the variance."""
    kind, name = (panel.schema[c].dataType.simpleString() for c in (by, ticker))

    def weights(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                cov = np.array([list(x) for x in row.cov])
                w = risk_parity(cov)
                yield pd.DataFrame({by: [row[0]] * len(w), ticker: list(row.names), "weight": w, "risk": w * (cov @ w)})

    known = moments(panel, by, order, ticker, ret).where((F.col("n") >= 3) & (F.size("names") >= 2))
    return known.select(by, "names", "cov").mapInPandas(weights, f"{by} {kind}, {ticker} {name}, weight double, risk double")


def shortfall_weights(panel: DataFrame, by: str, order: str, ticker: str, ret: str, alpha: float = 0.95, cap: float = 0.1) -> DataFrame:
    """(by, ticker, weight, shortfall, target, gap, residual): the neutral weights of least shortfall with a mean of at least ``target``, a linear program a group.

    The target is the cap times the mean of all names, or 0 where that is negative.  A
    group's scenarios meet in one task, dates by names.
    """
    rows = complete(panel, by, order, ticker, ret)
    schema = T.StructType([panel.schema[by], panel.schema[ticker], *[T.StructField(c, T.DoubleType()) for c in ("weight", "shortfall", "target", "gap", "residual")]])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot(index=order, columns=ticker, values=ret).sort_index()
        x = wide.to_numpy(float)
        target = max(float(x.mean()), 0.0) * cap
        s = least_shortfall(x, alpha, cap, target=target)
        return pd.DataFrame({by: part[by].iloc[0], ticker: wide.columns, "weight": s.x, "shortfall": shortfall(x, s.x, alpha), "target": target, "gap": s.gap, "residual": s.residual})

    return rows.groupBy(by).applyInPandas(run, schema)
