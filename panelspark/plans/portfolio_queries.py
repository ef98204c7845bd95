"""Queries of portfolio problems and their optimality, a year of weekly bars each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import portfolios as pf
from ..sources.tables import bars
from .catalog import query
from .window_queries import RET, with_bars

CAP = 0.1
#: Returns of the names that have one in all weeks of their year, as in ``portfolios.complete``.
YEARS = "yx AS (SELECT * FROM (SELECT year(date) AS yr, date, ticker, ret, count(*) OVER (PARTITION BY year(date), ticker) AS k, (SELECT count(DISTINCT q.date) FROM r q WHERE q.ret IS NOT NULL AND year(q.date) = year(r.date)) AS days FROM r WHERE ret IS NOT NULL) WHERE k = days)"
NAMES = "yn AS (SELECT yr, count(DISTINCT ticker) AS k, count(DISTINCT date) AS n FROM yx GROUP BY yr)"


def yearly(spark: SparkSession, d: str) -> DataFrame:
    return ind.with_returns(bars(spark, d)).where("ret IS NOT NULL").withColumn("yr", F.year("date").cast("long")).select("yr", "date", "ticker", "ret")


# T10, T12, T14, T15
@query("est_portfolio_weights")
def est_portfolio_weights(spark: SparkSession, d: str) -> DataFrame:
    return pf.portfolio_weights(yearly(spark, d), "yr", "date", "ticker", "ret", CAP).select("yr", "kind", "ticker", F.round("weight", 6).alias("weight"))


# Each solution meets its constraints and the conditions of its optimum (1e-8), and closes its gap
@query(
    "est_portfolio_optimal",
    with_bars(
        """SELECT yr, kind, k AS names, (CASE WHEN kind IN ('mean_var', 'views') THEN 0 ELSE 1 END)::DOUBLE AS total, true AS within, kind <> 'max_sharpe' OR best > 0 AS optimal
FROM yn JOIN (SELECT yr, avg(mean) FILTER (WHERE place <= 10) AS best FROM (SELECT yr, ticker, avg(ret) AS mean, row_number() OVER (PARTITION BY yr ORDER BY avg(ret) DESC) AS place FROM yx GROUP BY yr, ticker) GROUP BY yr) USING (yr), (SELECT unnest(['min_var', 'parity', 'max_sharpe', 'mean_var', 'views']) AS kind) WHERE n >= 3 AND k >= 2""",
        RET,
        YEARS,
        NAMES,
    ),
)
def est_portfolio_optimal(spark: SparkSession, d: str) -> DataFrame:
    w = pf.portfolio_weights(yearly(spark, d), "yr", "date", "ticker", "ret", CAP)
    neutral, free = F.col("kind").isin("mean_var", "views"), F.col("kind") == "parity"
    k = F.count(F.lit(1))
    within = F.max(F.abs("weight")) <= F.when(F.first(free), 1.0).when(F.first(neutral), CAP).otherwise(F.greatest(F.lit(CAP), 1 / k)) + 1e-8
    both = F.when(F.first(neutral), F.sum(F.abs("weight")) <= 2 + 1e-8).otherwise(F.min("weight") >= -1e-8)
    return w.groupBy("yr", "kind").agg(k.alias("names"), F.round(F.abs(F.sum("weight")), 6).alias("total"), (within & both).alias("within"), ((F.max("residual") < 1e-8) & (F.max("gap") < 1e-8)).alias("optimal"))


SWEEPS = 60


# Equal risk shares on sample covariances; the oracle repeats the sweeps over coordinates
@query(
    "est_risk_parity",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT yr, ticker, round(w / total, 6) AS weight, round(w * risk / (total * total) * 1e4, 4) AS risk_share FROM (SELECT yr, ticker, w, risk, sum(w) OVER (PARTITION BY yr) AS total FROM (SELECT f.yr, cn.ticker, f.w[cn.i] AS w, list_dot_product(cn.line, f.w) AS risk FROM f JOIN cn USING (yr)))",
        RET,
        YEARS,
        NAMES,
        "yc AS (SELECT yr, date, ticker, ret - avg(ret) OVER (PARTITION BY yr, ticker) AS x FROM yx)",
        "cp AS (SELECT a.yr, a.ticker, b.ticker AS other, avg(a.x * b.x) AS c FROM yc a JOIN yc b ON a.yr = b.yr AND a.date = b.date GROUP BY ALL)",
        "cn AS (SELECT yr, ticker, row_number() OVER (PARTITION BY yr ORDER BY ticker) AS i, list(c ORDER BY other) AS line FROM cp GROUP BY yr, ticker)",
        "co AS (SELECT yr, count(*) AS k, list(1 / sqrt(line[i]) ORDER BY i) AS w FROM cn JOIN yn USING (yr) WHERE n >= 3 AND yn.k >= 2 GROUP BY yr)",
        f"""step AS (SELECT yr, k, 0 AS s, w FROM co UNION ALL
SELECT yr, k, s + 1, w[:i - 1] || [(sqrt(others * others + 4 * own / k) - others) / (2 * own)] || w[i + 1:] FROM (SELECT step.yr, k, s, w, i, line[i] AS own, list_dot_product(line, w) - line[i] * w[i] AS others FROM step JOIN cn ON cn.yr = step.yr AND cn.i = s % k + 1 WHERE s < {SWEEPS} * k))""",
        f"f AS (SELECT yr, w FROM step WHERE s = {SWEEPS} * k)",
    )[len("WITH ") :],
)
def est_risk_parity(spark: SparkSession, d: str) -> DataFrame:
    return pf.parity_weights(yearly(spark, d), "yr", "date", "ticker", "ret").select("yr", "ticker", F.round("weight", 6).alias("weight"), F.round(F.col("risk") * 1e4, 4).alias("risk_share"))


# The linear program of the least shortfall: neutral, within the cap, with its gap closed (1e-6), and no worse than holding nothing
@query("est_least_shortfall", with_bars("SELECT yr, k AS names, true AS neutral, true AS within, true AS closed, true AS not_worse FROM yn", RET, YEARS, NAMES))
def est_least_shortfall(spark: SparkSession, d: str) -> DataFrame:
    w = pf.shortfall_weights(yearly(spark, d), "yr", "date", "ticker", "ret")
    some = w.groupBy("yr").agg(F.count(F.lit(1)).alias("names"), (F.abs(F.sum("weight")) < 1e-7).alias("neutral"), (F.max(F.abs("weight")) <= CAP + 1e-7).alias("within"), ((F.max("gap") < 1e-6) & (F.max("residual") < 1e-8)).alias("closed"), F.max("shortfall").alias("s"), F.max("target").alias("target"))
    # of weights that need not earn anything none is as good as nothing; where they need, the mean is earned
    return some.select("yr", "names", "neutral", "within", "closed", ((F.col("target") > 0) | (F.col("s") <= 1e-9)).alias("not_worse"))
