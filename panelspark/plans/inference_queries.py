"""Queries of resampling inference, selection tests, capacity and signal backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag, lead
from ..operators import estimators as est
from ..operators import indicators as ind
from ..operators import inference, panels
from ..sources.tables import bars
from .catalog import query
from .metric_queries import MARKET, market
from .relational_queries import DAYS, WEIGHTS, signal
from .window_queries import RET, W, with_bars

RESAMPLES, BLOCK = 200, 10


def draws_sql(n: str, seed: int = 0) -> str:
    """CTE dr(resample, pos, times) for a scalar query n."""
    u = lambda salt: f"('0x' || substr(md5('{seed}{salt}-' || r || '-' || i), 1, 12))::BIGINT / 281474976710656.0"
    return f"""g AS (SELECT r, i, n, i = 0 OR {u('f')} < 1.0 / {BLOCK} AS fresh, floor({u('s')} * n)::BIGINT AS start FROM (SELECT n, unnest(range({RESAMPLES})) AS r FROM (SELECT {n} AS n)), (SELECT unnest(range({n})) AS i)),
dr AS (SELECT r AS resample, pos, count(*) AS times FROM (SELECT r, (last_value(CASE WHEN fresh THEN start END IGNORE NULLS) OVER w + i - last_value(CASE WHEN fresh THEN i END IGNORE NULLS) OVER w) % n AS pos FROM g WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY ALL)"""


def sharpe_sql(x: str) -> str:
    return f"sum(times * {x}) / sum(times) / sqrt(greatest((sum(times * {x} * {x}) - sum(times * {x}) * sum(times * {x}) / sum(times)) / (sum(times) - 1), 1e-24))"


PAIR = "pr AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, ret AS x, ret * CASE WHEN l > 0 THEN 1 ELSE 0.5 END AS y FROM (SELECT date, ret, lag(ret) OVER (ORDER BY date) AS l FROM m) WHERE l IS NOT NULL)"


# T4: the difference of two sizing rules' Sharpe ratios on common dates
@query(
    "stat_paired_bootstrap",
    with_bars(
        f"""SELECT round(any_value(diff), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(stddev_samp(d), 6) AS se, avg((abs(c) >= abs(diff))::INT)::DOUBLE AS p_value, (SELECT count(*) FROM pr) AS n
FROM (SELECT d, d - avg(d) OVER () AS c FROM (SELECT resample, {sharpe_sql('x')} - ({sharpe_sql('y')}) AS d FROM dr JOIN pr USING (pos) GROUP BY resample)), (SELECT {sharpe_sql('x')} - ({sharpe_sql('y')}) AS diff FROM (SELECT *, 1 AS times FROM pr))""",
        MARKET,
        PAIR,
        draws_sql("(SELECT count(*) FROM pr)"),
    ),
)
def stat_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d).withColumn("l", F.lag("ret").over(Window.orderBy("date"))).where("l IS NOT NULL")
    both = m.select("date", F.col("ret").alias("x"), (F.col("ret") * F.when(F.col("l") > 0, 1.0).otherwise(0.5)).alias("y"))
    out = inference.paired_difference(both, "date", "x", "y", RESAMPLES, BLOCK)
    return out.select(*[F.round(c, 6).alias(c) for c in ("diff", "lo", "hi", "se")], "p_value", "n")


#: Gains of each name over the mean of all names, on dates that all names have.
GAINS = """gn AS (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY date) + (ticker - 12) * 0.002 AS f FROM (SELECT *, count(*) OVER (PARTITION BY date) AS k, (SELECT count(DISTINCT ticker) FROM r) AS names FROM r WHERE ret IS NOT NULL) WHERE k = names),
gd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM gn)),
ga AS (SELECT pos, ticker AS model, f FROM gn JOIN gd USING (date))"""


def gains(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d))
    names = r.select("ticker").distinct().count()
    by = Window.partitionBy("date")
    return r.where("ret IS NOT NULL").withColumn("k", F.count(F.lit(1)).over(by)).withColumn("f", F.col("ret") - F.avg("ret").over(by) + (F.col("ticker") - 12) * 0.002).where(F.col("k") == names).select("date", "ticker", "f")


N_DAYS = "(SELECT count(*) FROM gd)"


def tested(stats: str, floor: str) -> str:
    return f"""SELECT round(any_value(statistic), 6) AS statistic, avg((top >= statistic)::INT)::DOUBLE AS p_value, any_value(best_model) AS best_model, any_value(n_models) AS n_models, {N_DAYS} AS n_periods
FROM (SELECT resample, greatest(max(sqrt({N_DAYS}) * (boot - centre) / omega), {floor}) AS top FROM (SELECT resample, model, sum(times * f) / {N_DAYS} AS boot FROM dr JOIN ga USING (pos) GROUP BY ALL) JOIN st USING (model) GROUP BY resample),
  (SELECT greatest(max(sqrt({N_DAYS}) * mean / omega), {floor}) AS statistic, arg_max(model, (mean / omega, -model)) AS best_model, count(*) AS n_models FROM st)"""


# T4: White's reality check
@query("stat_reality_check", with_bars(tested("", "-1e300"), RET, GAINS, "st AS (SELECT model, avg(f) AS mean, 1.0 AS omega, avg(f) AS centre FROM ga GROUP BY model)", draws_sql(N_DAYS)))
def stat_reality_check(spark: SparkSession, d: str) -> DataFrame:
    out = inference.best_of_many(gains(spark, d), "date", "ticker", "f", RESAMPLES, BLOCK, studentised=False)
    return out.withColumn("statistic", F.round("statistic", 6))


def spa_stats() -> str:
    """Long-run deviations with the automatic number of lags, written out for up to 12 of them."""
    lags = f"least(floor(4 * pow({N_DAYS} / 100.0, 2.0 / 9)), {N_DAYS} - 1)"
    shifted = ", ".join(f"d * lag(d, {k}) OVER (PARTITION BY model ORDER BY pos) AS p{k}" for k in range(1, 13))
    terms = " + ".join(f"CASE WHEN {k} <= {lags} THEN 2 * (1 - {k} / ({lags} + 1)) * coalesce(sum(p{k}), 0) ELSE 0 END" for k in range(1, 13))
    return f"""st AS (SELECT model, mean, omega, CASE WHEN mean >= -omega * sqrt(2 * ln(greatest(ln({N_DAYS}), 1.0001)) / {N_DAYS}) THEN mean ELSE 0 END AS centre
FROM (SELECT model, avg(f) AS mean, sqrt(greatest((sum(d * d) + {terms}) / {N_DAYS}, 1e-12)) AS omega FROM (SELECT *, {shifted} FROM (SELECT *, f - avg(f) OVER (PARTITION BY model) AS d FROM ga)) GROUP BY model))"""


# T4: Hansen's test of superior predictive ability
@query("stat_superior_ability", with_bars(tested("", "0.0"), RET, GAINS, spa_stats(), draws_sql(N_DAYS)))
def stat_superior_ability(spark: SparkSession, d: str) -> DataFrame:
    out = inference.best_of_many(gains(spark, d), "date", "ticker", "f", RESAMPLES, BLOCK, studentised=True)
    return out.withColumn("statistic", F.round("statistic", 6))


# Probability of backtest overfitting, all 252 splits
@query(
    "est_overfitting",
    with_bars(
        """SELECT avg((rank / (m + 1.0) <= 0.5)::INT)::DOUBLE AS pbo, count(*) AS splits, max(m) AS strategies, (SELECT count(*) FROM od) AS periods
FROM (SELECT split, count(*) FILTER (WHERE unseen < chosen) + 1 AS rank, any_value(m) AS m FROM (SELECT *, first_value(unseen) OVER (PARTITION BY split ORDER BY seen DESC, s) AS chosen, count(*) OVER (PARTITION BY split) AS m
  FROM (SELECT split, s, max(sr) FILTER (WHERE inside) AS seen, max(sr) FILTER (WHERE NOT inside) AS unseen FROM (SELECT split, s, (split >> block) & 1 = 1 AS inside, avg(ret) / nullif(stddev_samp(ret), 0) AS sr FROM (SELECT range AS split FROM range(1024) WHERE bit_count(range) = 5), ob GROUP BY ALL) GROUP BY split, s)) GROUP BY split)""",
        RET,
        "od AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM r WHERE ret IS NOT NULL))",
        "ob AS (SELECT ticker AS s, ret, ((pos + 1) * 10 - 1) // n AS block FROM r JOIN od USING (date) WHERE ret IS NOT NULL)",
    ),
)
def est_overfitting(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d)).where("ret IS NOT NULL").select("date", "ticker", "ret")
    return inference.overfitting_probability(r, "date", "ticker", "ret")


# The size at which trades reach one hundredth of the value traded
@query(
    "agg_capacity",
    with_bars("SELECT round(sum(adv) * 0.01 / any_value(turnover), 2) AS capacity FROM (SELECT ticker, avg(close * volume) AS adv FROM bars GROUP BY ticker), (SELECT avg(traded) AS turnover FROM t WHERE date > (SELECT min(date) FROM t))", *WEIGHTS, DAYS),
)
def agg_capacity(spark: SparkSession, d: str) -> DataFrame:
    adv = bars(spark, d).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    days = panels.backtest(panels.decile_weights(signal(spark, d), "x"), 0.0)
    turnover = days.where(F.col("date") > F.lit(days.agg(F.min("date")).first()[0])).agg(F.avg("traded").alias("turnover"))
    both = adv.crossJoin(F.broadcast(turnover))
    return inference.capacity(both, "adv", F.first("turnover")).select(F.round("capacity", 2).alias("capacity"))


SIGNALS = f"""sg AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, close AS entry, coalesce(last_close5, last_close) AS exit, floor(400000 / close)::BIGINT AS qty, CASE WHEN x > 0.05 THEN 1 WHEN x < -0.05 THEN -1 ELSE 0 END AS dir
FROM (SELECT *, lead(close, 5) OVER {W} AS last_close5, last_value(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close, ln(close / lag(close, 5) OVER {W}) AS x FROM bars) WHERE x IS NOT NULL)"""


# Signals in turn with one capital a name; one that costs more than is left is passed over
@query(
    "est_signal_backtest",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT ticker, k, round(capital, 4) AS capital, taken FROM c WHERE k > 0",
        SIGNALS,
        "cs AS (SELECT *, entry * 1.0005 AS e, exit * 0.9995 AS o, entry * 1.0005 * qty * 0.001 AS fee FROM sg)",
        """c AS (SELECT DISTINCT ticker, 0::BIGINT AS k, 1000000.0::DOUBLE AS capital, false AS taken FROM sg
UNION ALL SELECT c.ticker, cs.k, c.capital + CASE WHEN cs.e * cs.qty + cs.fee > c.capital THEN 0 ELSE (cs.o - cs.e) * cs.qty * cs.dir - 2 * cs.fee END, NOT (cs.e * cs.qty + cs.fee > c.capital) FROM c JOIN cs ON c.ticker = cs.ticker AND cs.k = c.k + 1)""",
    )[len("WITH ") :],
)
def est_signal_backtest(spark: SparkSession, d: str) -> DataFrame:
    last = F.last("close").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = bars(spark, d).withColumns({"x": ind.log_return(5), "exit": F.coalesce(lead(F.col("close"), 5), last)}).where("x IS NOT NULL")
    way = F.when(F.col("x") > 0.05, 1).when(F.col("x") < -0.05, -1).otherwise(0)
    rows = df.select("ticker", "date", F.col("close").alias("entry"), "exit", F.floor(400000 / F.col("close")).alias("qty"), way.alias("way"))
    out = est.signal_backtests(rows, "ticker", "date")
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("date")).cast("long")
    return out.select("ticker", k.alias("k"), F.round("capital", 4).alias("capital"), "taken")
