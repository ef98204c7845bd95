"""Queries of metrics, statistics, calibration, sizing and allocation."""

from __future__ import annotations

import math
import statistics

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..operators import indicators as ind
from ..operators import metrics, panels
from ..sources.tables import bars, events, table
from .catalog import query
from .relational_queries import DAYS, SIGNAL, WEIGHTS, signal, sql
from .window_queries import RET, with_bars

#: Class scores in closed form, for metrics of probabilities.
PRED = """pred AS (SELECT doc_id, y, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM (
  SELECT d.doc_id, l.quality + l.toxic AS y, exp((n_chars % 17) / 8.0) AS e0, exp((n_chars % 13) / 6.0) AS e1, exp((n_chars % 7) / 3.0) AS e2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""
YHAT = "h AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yhat FROM pred)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("y"))
    p = finance.softmax([F.col("n_chars") % 17 / 8.0, F.col("n_chars") % 13 / 6.0, F.col("n_chars") % 7 / 3.0])
    df = docs.join(labels, "doc_id").select("doc_id", "y", *[x.alias(f"p{i}") for i, x in enumerate(p)])
    ps = [F.col(f"p{i}") for i in range(3)]
    return df.withColumns({"conf": F.greatest(*ps), "yhat": finance.argmax(ps).cast("int")})


# A11
@query("agg_confusion", sql("SELECT a.range::INT AS y, b.range::INT AS yhat, count(h.doc_id) AS n FROM range(3) a CROSS JOIN range(3) b LEFT JOIN h ON h.y = a.range AND h.yhat = b.range GROUP BY ALL", PRED, YHAT))
def agg_confusion(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.range(3).select(F.col("id").cast("int").alias("y"))
    grid = classes.crossJoin(classes.withColumnRenamed("y", "yhat"))
    counts = predictions(spark, d).groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


# A12, A43
@query(
    "agg_classification",
    sql(
        "SELECT k::INT AS class, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS prec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS acc FROM (SELECT r.range AS k, count(*) FILTER (WHERE y = r.range AND yhat = r.range)::DOUBLE AS tp, count(*) FILTER (WHERE y <> r.range AND yhat = r.range)::DOUBLE AS fp, count(*) FILTER (WHERE y = r.range AND yhat <> r.range)::DOUBLE AS fn, count(*) FILTER (WHERE y <> r.range AND yhat <> r.range)::DOUBLE AS tn FROM h CROSS JOIN range(3) r GROUP BY r.range)",
        PRED,
        YHAT,
    ),
)
def agg_classification(spark: SparkSession, d: str) -> DataFrame:
    each = predictions(spark, d).select("y", "yhat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("class"))
    y, h, k = F.col("y"), F.col("yhat"), F.col("class")
    c = each.groupBy("class").agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", (y == k) & (h == k)), ("fp", (y != k) & (h == k)), ("fn", (y == k) & (h != k)), ("tn", (y != k) & (h != k)))])
    div = lambda a, b: F.round(a / F.nullif(b, F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("class", div(tp, tp + fn).alias("recall"), div(tp, tp + fp).alias("prec"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + tn, tp + tn + fp + fn).alias("acc"))


# A13, A14, A33
@query(
    "agg_brier_nll",
    sql("SELECT round(avg(pow(p0 - (y = 0)::INT, 2) + pow(p1 - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2)), 6) AS brier, round(-avg(ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))), 6) AS nll FROM h", PRED, YHAT),
)
def agg_brier_nll(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    own = F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2"))
    brier = sum((F.pow(F.col(f"p{k}") - (F.col("y") == k).cast("int"), 2) for k in range(1, 3)), F.pow(F.col("p0") - (F.col("y") == 0).cast("int"), 2))
    return p.agg(F.round(F.avg(brier), 6).alias("brier"), F.round(-F.avg(F.log(F.greatest(own, F.lit(1e-12)))), 6).alias("nll"))


# A15, A16, A37
@query("agg_ece_bins", sql("SELECT r.range::INT AS bin, count(h.doc_id) AS n, round(avg(conf), 6) AS conf, round(avg((yhat = y)::INT), 6) AS acc FROM range(15) r LEFT JOIN h ON least(floor(conf * 15), 14) = r.range GROUP BY r.range", PRED, YHAT))
def agg_ece_bins(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.calibration_bins(predictions(spark, d), F.col("conf"), F.col("yhat") == F.col("y"), 15)
    return b.select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query("agg_ece", sql("SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS mce FROM (SELECT least(floor(conf * 15), 14) AS b, count(*) AS n, avg(conf) AS c, avg((yhat = y)::INT) AS a FROM h GROUP BY b)", PRED, YHAT))
def agg_ece(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.calibration_bins(predictions(spark, d), F.col("conf"), F.col("yhat") == F.col("y"), 15).where("n > 0")
    gap = F.abs(F.col("acc") - F.col("conf"))
    return b.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


# A3, A5, A6, A40
@query("agg_class_weights", sql("SELECT y, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, round(sum(count(*)) OVER () / (3.0 * count(*)), 6) AS weight FROM pred GROUP BY y", PRED))
def agg_class_weights(spark: SparkSession, d: str) -> DataFrame:
    c = predictions(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("y", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(total / (3.0 * F.col("n")), 6).alias("weight"))


MARKET = "m AS (SELECT date, avg(close / c0 - 1) / 100 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS c0 FROM bars) WHERE c0 IS NOT NULL GROUP BY date)"


def market(spark: SparkSession, d: str) -> DataFrame:
    """Mean return of all names by date, scaled to the size of market returns."""
    df = ind.with_returns(bars(spark, d)).withColumn("c0", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))).where("c0 IS NOT NULL")
    return df.groupBy("date").agg((F.avg(F.col("close") / F.col("c0") - 1) / 100).alias("ret"))


# A17 to A20, A22, A24
@query(
    "agg_performance",
    with_bars(
        "SELECT round(exp(sum(ln(1 + ret)) * 52 / count(ret)) - 1, 6) AS ann_return, round(stddev_samp(ret) * sqrt(52), 6) AS ann_vol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) AS sharpe, round(avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(52), 6) AS sortino, round(kurtosis_pop(ret), 6) AS kurt, round(avg(CASE WHEN ret <> 0 THEN (ret > 0)::INT END), 6) AS hit_rate FROM m",
        MARKET,
    ),
)
def agg_performance(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.performance(market(spark, d), "ret", 52)
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


# A21, A25, A27
@query("agg_drawdown", with_bars("SELECT date, round(e, 6) AS equity, round(1 - e / greatest(max(e) OVER (ORDER BY date), 1), 6) AS drawdown FROM (SELECT date, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS e FROM m)", MARKET))
def agg_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.drawdown(market(spark, d), "ret", "date").select("date", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


# A25, A26
@query("agg_var_cvar", with_bars("SELECT round(q, 6) AS var_95, round((SELECT avg(ret) FROM m WHERE ret <= q), 6) AS cvar_95, round((SELECT avg(ret) - 1.645 * stddev_pop(ret) FROM m), 6) AS var_normal FROM (SELECT quantile_cont(ret, 0.05) AS q FROM m)", MARKET))
def agg_var_cvar(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d)
    q = m.agg(F.percentile("ret", F.lit(0.05)).alias("q"), (F.avg("ret") - 1.645 * F.stddev_pop("ret")).alias("v"))
    return m.crossJoin(q).agg(F.round(F.first("q"), 6).alias("var_95"), F.round(F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))), 6).alias("cvar_95"), F.round(F.first("v"), 6).alias("var_normal"))


def lrv_sql(series: str, lags: int) -> str:
    parts = ["sum(d * d)"] + [f"2 * (1 - {k} / {lags + 1}.0) * sum(d * l{k})" for k in range(1, lags + 1)]
    shifted = ", ".join(f"lag(d, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, lags + 1))
    return f"(SELECT avg(mean) AS mean, count(*) AS n, ({' + '.join(parts)}) / count(*) AS lrv FROM (SELECT *, {shifted} FROM (SELECT date, x - avg(x) OVER () AS d, avg(x) OVER () AS mean FROM {series})))"


# T1, T2
@query("stat_newey_west", with_bars(f"SELECT round(mean, 8) AS mean, n, round(lrv * 1e4, 6) AS lrv, round(mean / sqrt(lrv / n), 6) AS t_stat FROM {lrv_sql('(SELECT date, ret AS x FROM m)', 5)}", MARKET))
def stat_newey_west(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.newey_west(market(spark, d), "ret", "date", 5)
    return out.select(F.round("mean", 8).alias("mean"), "n", F.round(F.col("lrv") * 1e4, 6).alias("lrv"), F.round("t_stat", 6).alias("t_stat"))


# Loss difference of two forecasts, small-sample factor
@query(
    "stat_diebold_mariano",
    with_bars(f"SELECT n, round(mean / sqrt(lrv / n) * sqrt((n + 1 - 2 * 5 + 5 * 4.0 / n) / n), 6) AS dm FROM {lrv_sql('(SELECT date, pow(ret - 0.001, 2) - pow(ret - l, 2) AS x FROM (SELECT date, ret, lag(ret) OVER (ORDER BY date) AS l FROM m) WHERE l IS NOT NULL)', 4)}", MARKET),
)
def stat_diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d).withColumn("l", F.lag("ret").over(Window.orderBy("date"))).where("l IS NOT NULL")
    out = metrics.newey_west(m.withColumn("x", F.pow(F.col("ret") - 0.001, 2) - F.pow(F.col("ret") - F.col("l"), 2)), "x", "date", 4)
    n = F.col("n")
    return out.select("n", F.round(F.col("t_stat") * F.sqrt((n + 1 - 2 * 5 + 5 * 4.0 / n) / n), 6).alias("dm"))


#: Per-period Sharpe ratio with bias-corrected skew and (not excess) kurtosis, its standard error and z.
SHARPE = """sh AS (SELECT n, sr, s, k, sqrt(greatest(1 - s * sr + (k - 1) / 4 * sr * sr, 1e-12) / (n - 1)) AS se FROM (SELECT n, mu / sd AS sr, m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) AS s, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3 AS k
FROM (SELECT count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, avg(pow(c, 2)) AS m2, avg(pow(c, 3)) AS m3, avg(pow(c, 4)) AS m4 FROM (SELECT ret, ret - avg(ret) OVER () AS c FROM m))))"""


def normal_cdf_sql(z: str) -> str:
    """The normal distribution function as its series in odd powers."""
    return f"(0.5 + exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(150), lambda i: sign({z}) * exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - ((i + 1) * ln(2) + lgamma(i + 1.5) - ln(pi()) / 2)))))"


# T5: standard error and z of the probabilistic Sharpe ratio
@query("stat_psr", with_bars("SELECT n, round(sr, 6) AS sr, round(se, 6) AS se, round(sr / se, 6) AS z FROM sh", MARKET, SHARPE))
def stat_psr(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.sharpe_moments(market(spark, d), "ret")
    return a.select("n", F.round("sr", 6).alias("sr"), F.round("se", 6).alias("se"), F.round(F.col("sr") / F.col("se"), 6).alias("z"))


TRIALS = 20


def trial_factor() -> float:
    """Expected largest of TRIALS standard normal ratios, nearly."""
    norm, gamma = statistics.NormalDist(), 0.5772156649015329
    return (1 - gamma) * norm.inv_cdf(1 - 1 / TRIALS) + gamma * norm.inv_cdf(1 - 1 / (TRIALS * math.e))


# Normal probabilities of a few numbers on the driver
@query("stat_deflated_sharpe", with_bars(f"SELECT {TRIALS}::INT AS trials, round(se * {trial_factor()!r}, 6) AS expected_max, round({normal_cdf_sql('(sr / se)')}, 6) AS psr, round({normal_cdf_sql(f'((sr - se * {trial_factor()!r}) / se)')}, 6) AS dsr FROM sh", MARKET, SHARPE))
def stat_deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    row, norm = metrics.sharpe_moments(market(spark, d), "ret").first(), statistics.NormalDist()
    high = row["se"] * trial_factor()
    figures = (high, norm.cdf(row["sr"] / row["se"]), norm.cdf((row["sr"] - high) / row["se"]))
    return spark.createDataFrame([(TRIALS, *(round(float(x), 6) for x in figures))], "trials int, expected_max double, psr double, dsr double")


# T9, J13
@query("stat_factor_regression", with_bars("SELECT x.ticker, count(*) AS n, round(regr_slope(x.r, m.ret), 6) AS beta, round(regr_intercept(x.r, m.ret), 6) AS alpha, round(regr_r2(x.r, m.ret), 6) AS r2 FROM (SELECT ticker, date, (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) / 100 AS r FROM bars) x JOIN m USING (date) WHERE r IS NOT NULL GROUP BY x.ticker HAVING count(*) >= 30", MARKET))
def stat_factor_regression(spark: SparkSession, d: str) -> DataFrame:
    own = bars(spark, d).withColumn("r", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1) / 100).where("r IS NOT NULL")
    both = own.join(market(spark, d).withColumnRenamed("ret", "f"), "date")
    fit = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.round(g("r", "f"), 6).alias(n) for n, g in (("beta", F.regr_slope), ("alpha", F.regr_intercept), ("r2", F.regr_r2))])
    return fit.where("n >= 30")


# Pairwise covariance and the shrinkage target
@query(
    "stat_covariance_pairs",
    with_bars("SELECT a.ticker AS t1, b.ticker AS t2, count(*) AS n, round(covar_pop(a.ret, b.ret), 6) AS cov, round(corr(a.ret, b.ret), 6) AS rho FROM r a JOIN r b ON a.date = b.date AND a.ticker <= b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 30", RET),
)
def stat_covariance_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d)).where("ret IS NOT NULL").select("date", "ticker", "ret")
    a, b = r.select("date", F.col("ticker").alias("t1"), F.col("ret").alias("x")), r.select("date", F.col("ticker").alias("t2"), F.col("ret").alias("y"))
    # names of one date: the pairs are the answer itself
    return a.join(b, "date").where("t1 <= t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.round(F.covar_pop("x", "y"), 6).alias("cov"), F.round(F.corr("x", "y"), 6).alias("rho")).where("n >= 30")


# F1 to F6, F9 to F11, F13
@query(
    "fn_kelly",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mu / greatest(s2, 1e-12), 6) AS f1, round(greatest(least(0.25 * (mu / greatest(s2, 1e-12)), 0.5), -0.5), 6) AS f9, round(0.3 * mu - 0.5 * 0.3 * 0.3 * s2, 6) AS f2, round(2 * u - u * u, 6) AS f4, round(u - (1 - u) / 1.5, 6) AS f5, round(greatest(least(0.5 * (u / 0.8 - (1 - u) / 1.2), 1), 0), 6) AS f13
FROM (SELECT *, l_discount - 0.05 AS mu, l_tax * l_tax + 0.01 AS s2, l_quantity / 50 AS u FROM lineitem)""",
)
def fn_kelly(spark: SparkSession, d: str) -> DataFrame:
    mu, s2, u = F.col("l_discount") - 0.05, F.col("l_tax") * F.col("l_tax") + 0.01, F.col("l_quantity") / 50
    values = {"f1": finance.kelly(mu, s2), "f9": finance.fractional_kelly(mu, s2, 0.25, 0.5), "f2": finance.log_growth(F.lit(0.3), mu, s2), "f4": finance.growth_from_variance_ratio(u), "f5": finance.binary_kelly(u, 1.5), "f13": finance.half_kelly_long_only(u, 1.2, 0.8, 0.5)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(x, 6).alias(n) for n, x in values.items()])


# F16, F17, F18
@query("fn_temperature", sql("SELECT doc_id, round(q0 / (q0 + q1 + q2), 6) AS t0, round(q2 / (q0 + q1 + q2), 6) AS t2 FROM (SELECT doc_id, exp(ln(p0) / 1.7) AS q0, exp(ln(p1) / 1.7) AS q1, exp(ln(p2) / 1.7) AS q2 FROM pred)", PRED))
def fn_temperature(spark: SparkSession, d: str) -> DataFrame:
    t = finance.softmax([F.log(f"p{i}") for i in range(3)], 1.7)
    return predictions(spark, d).select("doc_id", F.round(t[0], 6).alias("t0"), F.round(t[2], 6).alias("t2"))


# F19, F20, T19
@query(
    "fn_conformal_sets",
    sql(
        """SELECT h.doc_id, (1 - p0 <= q OR yhat = 0)::INT + (1 - p1 <= q OR yhat = 1)::INT + (1 - p2 <= q OR yhat = 2)::INT AS set_size, round(q, 6) AS q FROM h CROSS JOIN (
  SELECT max(s) FILTER (WHERE rk = 1 + ceil(least(ceil((n + 1) * 0.9) / n, 1) * (n - 1))) AS q FROM (SELECT s, row_number() OVER (ORDER BY s) AS rk, count(*) OVER ()::DOUBLE AS n FROM (SELECT 1 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS s FROM h WHERE doc_id % 2 = 0)))
WHERE doc_id % 2 = 1""",
        PRED,
        YHAT,
    ),
)
def fn_conformal_sets(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    score = 1 - F.when(F.col("y") == 0, F.col("p0")).when(F.col("y") == 1, F.col("p1")).otherwise(F.col("p2"))
    cal = p.where("doc_id % 2 = 0").select(score.alias("s"))
    # the order statistic by an exact percentile: no global sort in one task
    n = cal.count()
    level = min(-(-(n + 1) * 9 // 10) / n, 1.0) if n else 1.0
    rank = int(-(-level * (n - 1) // 1)) if n else 0
    q = cal.agg(F.expr(f"percentile(s, {rank / max(n - 1, 1)!r}D)").alias("q"))
    member = lambda k: ((1 - F.col(f"p{k}") <= F.col("q") + 1e-12) | (F.col("yhat") == k)).cast("int")
    return p.where("doc_id % 2 = 1").crossJoin(F.broadcast(q)).select("doc_id", (member(0) + member(1) + member(2)).alias("set_size"), F.round("q", 6).alias("q"))


# F21, A45, W50
@query("fn_cost_rate", with_bars("SELECT ticker, date, round(0.0005 + 0.1 * 0.02 * sqrt(1e6 / nullif(close * volume, 0)), 8) AS rate FROM bars"))
def fn_cost_rate(spark: SparkSession, d: str) -> DataFrame:
    rate = finance.cost_rate(F.lit(1e6), F.col("close") * F.col("volume"), F.lit(0.02), 0.0005, 0.1)
    return bars(spark, d).select("ticker", "date", F.round(rate, 8).alias("rate"))


# caps, no net position, gross leverage at most 1
@query(
    "fn_capped_weights",
    with_bars(
        "SELECT ticker, date, round(c * least(1, 1 / nullif(sum(abs(c)) OVER (PARTITION BY date), 0)), 6) AS weight FROM (SELECT ticker, date, greatest(least(x - avg(x) OVER (PARTITION BY date), 0.2), -0.2) AS c FROM u WHERE x IS NOT NULL)",
        *SIGNAL,
    ),
)
def fn_capped_weights(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("date")
    df = signal(spark, d).where("x IS NOT NULL").withColumn("c", finance.clip(F.col("x") - F.avg("x").over(w), -0.2, 0.2))
    scale = F.least(F.lit(1.0), 1 / F.nullif(F.sum(F.abs("c")).over(w), F.lit(0.0)))
    return df.select("ticker", "date", F.round(F.col("c") * scale, 6).alias("weight"))


# buckets, targets and stops
@query(
    "fn_signal_class",
    sql("SELECT doc_id, CASE WHEN p2 >= 0.6 THEN 'STRONG_BUY' WHEN p2 >= 0.45 THEN 'BUY' WHEN p2 >= 0.3 THEN 'HOLD' WHEN p2 >= 0.2 THEN 'SELL' ELSE 'STRONG_SELL' END AS signal, list_filter([CASE WHEN p2 > p0 THEN 'up' END, CASE WHEN p1 > 0.4 THEN 'flat' END], lambda x: x IS NOT NULL)::VARCHAR AS why FROM pred", PRED),
)
def fn_signal_class(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p2")
    bucket = F.when(p >= 0.6, "STRONG_BUY").when(p >= 0.45, "BUY").when(p >= 0.3, "HOLD").when(p >= 0.2, "SELL").otherwise("STRONG_SELL")
    why = F.array_compact(F.array(F.when(F.col("p2") > F.col("p0"), "up"), F.when(F.col("p1") > 0.4, "flat")))
    return predictions(spark, d).select("doc_id", bucket.alias("signal"), F.concat(F.lit("["), F.array_join(why, ", "), F.lit("]")).alias("why"))


# F24, F15, ST20
@query("fn_allocation", "SELECT c_custkey, lots, round(lots * 10.0, 6) AS spent, round(sum(lots * 10.0) OVER (PARTITION BY c_nationkey) / 1e6, 6) AS used FROM (SELECT c_custkey, c_nationkey, floor(1e6 / count(*) OVER (PARTITION BY c_nationkey) * (abs(c_acctbal) / 10000) / 10)::BIGINT AS lots FROM customer)")
def fn_allocation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    lots = F.floor(1e6 / F.count(F.lit(1)).over(w) * (F.abs("c_acctbal") / 10000) / 10)
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", lots.alias("lots"))
    return df.select("c_custkey", "lots", F.round(F.col("lots") * 10.0, 6).alias("spent"), F.round(F.sum(F.col("lots") * 10.0).over(w) / 1e6, 6).alias("used"))


# A44
@query("agg_break_even", with_bars("SELECT round(avg(gross) / nullif(avg(traded), 0) * 1e4, 4) AS break_even_bps FROM t", *WEIGHTS, DAYS))
def agg_break_even(spark: SparkSession, d: str) -> DataFrame:
    days = panels.backtest(panels.decile_weights(signal(spark, d), "x"), 0.0)
    return days.agg(F.round(F.avg("gross") / F.nullif(F.avg("traded"), F.lit(0.0)) * 1e4, 4).alias("break_even_bps"))


# A user's statistic as a grouped aggregate
@query("udf_user_statistic", "SELECT event_type, round(median(value), 6) AS stat FROM events GROUP BY event_type")
def udf_user_statistic(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def statistic(x: pd.Series) -> float:
        return float(x.median())

    return events(spark, d).groupBy("event_type").agg(F.round(statistic("value"), 6).alias("stat"))


# By year and variant, a grouping of measures
@query("agg_by_year_variant", with_bars("SELECT year(date) AS yr, v AS variant, round(avg(CASE v WHEN 'ret' THEN ret ELSE abs(ret) END), 6) AS mean FROM r CROSS JOIN (SELECT unnest(['ret', 'abs']) AS v) WHERE ret IS NOT NULL GROUP BY ALL", RET))
def agg_by_year_variant(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d)).where("ret IS NOT NULL")
    long = r.select(F.year("date").cast("long").alias("yr"), F.expr("stack(2, 'ret', ret, 'abs', abs(ret)) AS (variant, x)"))
    return long.groupBy("yr", "variant").agg(F.round(F.avg("x"), 6).alias("mean"))
