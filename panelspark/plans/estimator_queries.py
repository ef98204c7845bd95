"""Queries of sequential and iterative estimators; rows only, their kernels are tested against NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import lag, lead
from ..operators import estimators as est
from ..operators import indicators as ind
from ..operators import inference
from ..sources.tables import bars
from ..streaming import candles, tunnels
from .catalog import query
from .inference_queries import BLOCK, RESAMPLES, draws_sql
from .metric_queries import MARKET, PRED, market, predictions
from .relational_queries import sql
from .window_queries import LIVES, W, lives, with_bars


LOGITS = "pz AS (SELECT doc_id % 4 AS fold, ln(p0) AS z0, ln(p1) AS z1, ln(p2) AS z2, y, greatest(ln(p0), ln(p1), ln(p2)) AS h, CASE y WHEN 0 THEN ln(p0) WHEN 1 THEN ln(p1) ELSE ln(p2) END AS own FROM pred)"


def passes_sql(points: int = 24, passes: int = 4) -> list[str]:
    """CTEs t0 to t4: the best temperature so far of each fold, closer in each pass."""
    middle, width = (math.log(0.05) + math.log(20.0)) / 2, (math.log(20.0) - math.log(0.05)) / 2
    out = [f"t0 AS (SELECT DISTINCT fold, {middle!r} AS m FROM pz)"]
    for k in range(passes):
        steps = ", ".join(repr(float(s)) for s in np.linspace(-width, width, points))
        out.append(
            f"t{k + 1} AS (SELECT fold, any_value(m) + arg_min(s, loss) AS m, any_value(n) AS n FROM (SELECT fold, m, s, count(*) AS n, sum(ln(exp((z0 - h) * t) + exp((z1 - h) * t) + exp((z2 - h) * t)) - (own - h) * t) AS loss FROM (SELECT pz.*, m, s, exp(-(m + s)) AS t FROM pz JOIN t{k} USING (fold), (SELECT unnest([{steps}])::DOUBLE AS s)) GROUP BY fold, m, s) GROUP BY fold)"
        )
        width = 2 * width / (points - 1)
    return out


# T17, T18
@query("est_temperature", sql("SELECT fold, round(exp(m), 4) AS temperature, n FROM t4", PRED, LOGITS, *passes_sql()))
def est_temperature(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).select((F.col("doc_id") % 4).alias("fold"), *[F.log(f"p{i}").alias(f"z{i}") for i in range(3)], "y")
    return est.temperatures(p, "fold", ["z0", "z1", "z2"], "y").withColumn("temperature", F.round("temperature", 4))


def conformal_sql(rows: str, key: str, width: float, cells: int, alpha: float = 0.1, gamma: float = 0.01, warm: int = 30) -> str:
    """CTE s(key, pos, covered, level_before) over rows(key, pos, score): the level's recursion with all cells so far."""
    return f"""s AS (SELECT DISTINCT {key}, 0::BIGINT AS pos, []::BIGINT[] AS past, {alpha}::DOUBLE AS level, NULL::BOOLEAN AS covered, NULL::DOUBLE AS before FROM {rows}
UNION ALL
SELECT {key}, pos, past || [cell], CASE WHEN covered IS NULL THEN level ELSE level + {gamma} * ({alpha} - (NOT covered)::INT) END, covered, CASE WHEN covered IS NOT NULL THEN level END
FROM (SELECT *, CASE WHEN len(past) >= {warm} THEN level <= 0 OR cell <= list_sort(past)[greatest(least(ceil(least(greatest(1 - level, 0), 1) * (len(past) - 1) - 1e-9), len(past) - 1), 0)::BIGINT + 1] END AS covered
FROM (SELECT s.{key}, q.pos, s.past, s.level, least(floor(q.score / {width}), {cells} - 1)::BIGINT AS cell FROM s JOIN {rows} q ON q.{key} = s.{key} AND q.pos = s.pos + 1)))"""


# ST14
@query(
    "est_online_conformal",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT s.ticker, q.date, s.covered, round(s.before, 9) AS level FROM s JOIN q ON q.ticker = s.ticker AND q.pos = s.pos WHERE s.covered IS NOT NULL",
        f"q AS (SELECT ticker, date, score, row_number() OVER {W} AS pos FROM (SELECT ticker, date, abs(ln(lead(close) OVER {W} / close)) AS score FROM bars) WHERE score IS NOT NULL)",
        conformal_sql("q", "ticker", 1e-4, 1 << 15),
    )[len("WITH ") :],
)
def est_online_conformal(spark: SparkSession, d: str) -> DataFrame:
    score = F.abs(F.log(lead(F.col("close")) / F.col("close")))
    found = est.online_conformal(bars(spark, d).withColumn("s", score).where("s IS NOT NULL").select("ticker", "date", "s"), "ticker", "date", "s")
    return found.withColumn("level", F.round("level", 9))


# ST14: the same machine in a stream's state
@query(
    "st_online_conformal",
    f"""WITH RECURSIVE q AS (SELECT user_id AS key, event_id, value / 100 AS score, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS pos FROM events),
{conformal_sql("q", "key", 1e-3, 1 << 12)}
SELECT s.key, q.event_id, s.covered, round(s.before, 9) AS level FROM s JOIN q ON q.key = s.key AND q.pos = s.pos WHERE s.covered IS NOT NULL""",
)
def st_online_conformal(spark: SparkSession, d: str) -> DataFrame:
    scores = candles.ticks(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("value") / 100).alias("score"))
    return candles.finished(tunnels.conformal(scores, width=1e-3, cells=1 << 12), "append").withColumn("level", F.round("level", 9))


# T4, SP9
@query(
    "est_bootstrap_interval",
    with_bars(
        "SELECT round(quantile_cont(s, 0.025), 8) AS low, round(avg(s), 8) AS mean, round(quantile_cont(s, 0.975), 8) AS high FROM (SELECT resample, sum(times * ret) / sum(times) AS s FROM dr JOIN (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS pos FROM m) USING (pos) GROUP BY resample)",
        MARKET,
        draws_sql("(SELECT count(*) FROM m)", 7),
    ),
)
def est_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    series = inference.placed(market(spark, d), "date")
    draws = inference.stationary_draws(spark, RESAMPLES, series.count(), BLOCK, 7).join(series, "pos")
    means = draws.groupBy("resample").agg((F.sum(F.col("times") * F.col("ret")) / F.sum("times")).alias("s"))
    return means.agg(F.round(F.percentile("s", F.lit(0.025)), 8).alias("low"), F.round(F.avg("s"), 8).alias("mean"), F.round(F.percentile("s", F.lit(0.975)), 8).alias("high"))


SEED = 3
DRAW = f"('0x' || substr(md5('{SEED}-' || s.ticker || '-' || s.draw), 1, 12))::BIGINT / 281474976710656.0"


# SP8: as many draws as labels; the oracle weighs all labels anew for each draw
@query(
    "est_sequential_bootstrap",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT ticker, draw::INT - 1 AS draw, pick AS pos FROM s WHERE draw > 0",
        LIVES,
        "lb AS (SELECT ticker, list({'a': pos, 'b': t1} ORDER BY pos) AS labels, max(t1) + 1 AS bars, count(*) AS n FROM x WHERE t1 IS NOT NULL GROUP BY ticker)",
        f"""s AS (SELECT ticker, 0::BIGINT AS draw, NULL::BIGINT AS pick, list_transform(range(bars), lambda i: 1.0::DOUBLE) AS u FROM lb
UNION ALL
SELECT ticker, draw + 1, p.a, u[:p.a] || list_transform(u[p.a + 1:p.b + 1], lambda v: 1 / (1 / v + 1)) || u[p.b + 2:]
FROM (SELECT *, labels[len(list_filter(cum, lambda c: c <= r * cum[-1])) + 1] AS p FROM (SELECT *, [x.c for x in cums] AS cum FROM (SELECT *, list_reduce(list_transform(w, lambda v: [{{'c': v}}]), lambda acc, v: acc || [{{'c': acc[-1].c + v[1].c}}]) AS cums
  FROM (SELECT s.ticker, s.draw, s.u, lb.labels, {DRAW} AS r, list_transform(lb.labels, lambda l: list_avg(s.u[l.a + 1:l.b + 1])) AS w FROM s JOIN lb USING (ticker) WHERE s.draw < lb.n)))))""",
    )[len("WITH ") :],
)
def est_sequential_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return est.sequential_bootstraps(lives(spark, d), "ticker", SEED)


# Three states of returns and their sizes, filtered and smoothed
@query("est_regimes")
def est_regimes(spark: SparkSession, d: str) -> DataFrame:
    found = est.regimes(ind.with_returns(bars(spark, d)).select("ticker", "date", "ret"), "ticker", "date", "ret")
    return found.select("ticker", "date", "state", F.round(F.array_max("filtered"), 4).alias("filtered"), F.round(F.col("smoothed")[F.col("state")], 4).alias("smoothed"))


# Positions by past wins and losses within risk limits, one account a name; at first 55 % of wins of 2 %
@query(
    "est_event_backtest",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT s.ticker, q.date, round(position, 6) AS position, round(equity, 2) AS equity, round(commission, 4) AS commission, round(slippage, 4) AS slippage FROM s JOIN q USING (ticker, pos)",
        f"q AS (SELECT ticker, date, close, row_number() OVER {W} AS pos, CASE WHEN f > 0.05 THEN 2 WHEN f < -0.05 THEN 0 ELSE 1 END AS side, least(abs(f) * 2, 1) AS conf FROM (SELECT ticker, date, pow(close, 0.05) AS close, coalesce(ln(close / lag(close, 5) OVER {W}), 0) AS f FROM bars))",
        """s AS (SELECT ticker, pos, side, conf, close, 1e6::DOUBLE AS equity, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS position, 0.0::DOUBLE AS commission, 0.0::DOUBLE AS slippage, []::DOUBLE[] AS wins, []::DOUBLE[] AS losses, [0.0]::DOUBLE[] AS rets FROM q WHERE pos = 1
UNION ALL
SELECT ticker, pos, side, conf, close, equity + gain, peak, new, traded * 5e-4, traded * 2e-4, CASE WHEN earned > 0 THEN wins || [earned] ELSE wins END, CASE WHEN earned < 0 THEN losses || [-earned] ELSE losses END, (rets || [CASE WHEN equity > 0 THEN gain / equity ELSE 0 END])[-21:]
FROM (SELECT *, earned * equity - traded * 5e-4 - traded * 2e-4 AS gain FROM (SELECT *, abs(new - position) * equity AS traded, new * (close - close0) / close0 AS earned FROM (SELECT *, CASE WHEN (equity - peak) / peak < -0.15 THEN 0 ELSE greatest(least(want, bound), -bound) END AS new
FROM (SELECT * , (side0 - 1) * least(greatest(CASE WHEN least(win, loss) < 1e-10 THEN 0 ELSE least(greatest((share / loss - (1 - share) / win) * 0.25, 0), 1) END * conf0, 0), 0.1) AS want, least(0.1, coalesce(CASE WHEN len(rets) >= 10 THEN 0.02 / nullif(1.645 * sd, 0) END, 0.1)) AS bound
FROM (SELECT q.ticker, q.pos, q.side, q.conf, q.close, s.close AS close0, s.side AS side0, s.conf AS conf0, s.equity, greatest(s.peak, s.equity) AS peak, s.position, s.wins, s.losses, s.rets, sqrt(list_avg(list_transform(s.rets, lambda r: pow(r - list_avg(s.rets), 2)))) AS sd,
  len(s.wins) >= 10 AND len(s.losses) >= 10 AS known, CASE WHEN known THEN len(s.wins) / (len(s.wins) + len(s.losses))::DOUBLE ELSE 0.55 END AS share, CASE WHEN known THEN list_avg(s.wins[-252:]) ELSE 0.02 END AS win, CASE WHEN known THEN list_avg(s.losses[-252:]) ELSE 0.02 END AS loss
  FROM s JOIN q ON q.ticker = s.ticker AND q.pos = s.pos + 1)))))
)""",
    )[len("WITH ") :],
)
def est_event_backtest(spark: SparkSession, d: str) -> DataFrame:
    f = F.coalesce(ind.log_return(5), F.lit(0.0))
    df = bars(spark, d).withColumn("f", f).withColumns({"side": F.when(F.col("f") > 0.05, 2).when(F.col("f") < -0.05, 0).otherwise(1), "conf": F.least(F.abs("f") * 2, F.lit(1.0))})
    # with even odds at first the rule would never open a position
    df = df.withColumn("close", F.pow("close", F.lit(0.05)))  # moves of the size of market returns
    out = est.event_backtests(df, "ticker", "date", "side", "conf", "close", prior=(0.55, 0.02, 0.02))
    return out.select("ticker", "date", F.round("position", 6).alias("position"), F.round("equity", 2).alias("equity"), F.round("commission", 4).alias("commission"), F.round("slippage", 4).alias("slippage"))
