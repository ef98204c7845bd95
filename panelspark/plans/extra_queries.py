"""Queries of universes, quotes, allocation records, risk figures and baselines."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance, text
from ..functions.rolling import by_ticker, lag
from ..operators import indicators as ind
from ..operators import metrics
from ..sources.tables import bars, events, table
from ..streaming import candles
from .catalog import query
from .metric_queries import MARKET, PRED, SHARPE, YHAT, market, predictions
from .relational_queries import sql
from .window_queries import RET, W, roll, rounded, with_bars


# Payloads of several providers, the best one of each key
@query("scan_provider_quotes", "SELECT user_id, arg_min(value, (prio, event_id)) AS price, arg_min((props ->> '$.k')::BIGINT, (prio, event_id)) AS k FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS prio FROM events) GROUP BY user_id")
def scan_provider_quotes(spark: SparkSession, d: str) -> DataFrame:
    prio = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    parsed = events(spark, d).select("user_id", "value", F.from_json("props", "k long")["k"].alias("k"), F.struct(prio.alias("prio"), "event_id").alias("o"))
    return parsed.groupBy("user_id").agg(F.min_by("value", "o").alias("price"), F.min_by("k", "o").alias("k"))


# Tradeable rows in both tables
@query("flt_tradeable", sql("SELECT h.doc_id, yhat FROM h JOIN labels USING (doc_id) WHERE conf >= 0.5", PRED, YHAT))
def flt_tradeable(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("conf >= 0.5").join(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", "yhat")


# Records as key and value
@query("agg_key_values", with_bars("SELECT key, value FROM (UNPIVOT (SELECT round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS sd, count(*)::DOUBLE AS n FROM m) ON mean, sd, n INTO NAME key VALUE value)", MARKET))
def agg_key_values(spark: SparkSession, d: str) -> DataFrame:
    one = market(spark, d).agg(F.round(F.avg("ret"), 8).alias("mean"), F.round(F.stddev_samp("ret"), 8).alias("sd"), F.count(F.lit(1)).cast("double").alias("n"))
    return one.select(F.expr("stack(3, 'mean', mean, 'sd', sd, 'n', n) AS (key, value)"))


def recursion(columns: dict[str, tuple[str, float, int]]) -> str:
    """CTE e(ticker, pos, ...) that carries all unseeded means at once: {out: (input of x, alpha, first position)}."""
    start = ", ".join(f"CASE WHEN {first} = 1 THEN {x} END AS {out}" for out, (x, _, first) in columns.items())
    step = ", ".join(f"CASE WHEN x.pos < {first} THEN NULL WHEN x.pos = {first} THEN x.{c} ELSE e.{out} + {alpha!r} * (x.{c} - e.{out}) END" for out, (c, alpha, first) in columns.items())
    return f"e AS (SELECT ticker, pos, {start} FROM x WHERE pos = 1 UNION ALL SELECT x.ticker, x.pos, {step} FROM e JOIN x ON x.ticker = e.ticker AND x.pos = e.pos + 1)"


def mean_sql(x: str, n: int, fn: str = "avg") -> str:
    return f"CASE WHEN count({x}) OVER {roll(n)} >= {n} THEN {fn}({x}) OVER {roll(n)} END"


SUITE_STEPS = {f"ema_{n}": ("close", 2 / (n + 1), 1) for n in (5, 10, 12, 20, 26, 50, 200)} | {f"{g}_{n}": (g, 1 / n, 2) for n in (14, 21) for g in ("gain", "loss")} | {"atr_14": ("tr", 1 / 14, 1)}
SUITE_SUMS = {f"sma_{n}": mean_sql("close", n) for n in (5, 10, 20, 50, 200)}
SUITE = {
    "rsi_14": "coalesce(100 - 100 / (1 + gain_14 / nullif(loss_14, 0)), 50)", "rsi_21": "coalesce(100 - 100 / (1 + gain_21 / nullif(loss_21, 0)), 50)", "macd": "ema_12 - ema_26", "macd_signal": "sig", "macd_hist": "ema_12 - ema_26 - sig",
    "bb_mid": "sma_20", "bb_upper": "sma_20 + 2 * sd", "bb_lower": "sma_20 - 2 * sd", "bb_width": "4 * sd / nullif(sma_20, 0)", "bb_position": "(close - (sma_20 - 2 * sd)) / nullif(4 * sd, 0)", "atr_14": "atr_14", "obv": "obv", "vwap": "vwap",
    "volume_sma_20": "volume_sma_20", "volume_ratio": "volume / nullif(volume_sma_20, 0)", **{f"{k}_{n}": f"{k}_{n}" for n in (5, 10, 20, 50, 200) for k in ("ema", "sma")},
    "price_vs_sma50": "(close - sma_50) / nullif(sma_50, 0)", "price_vs_sma200": "(close - sma_200) / nullif(sma_200, 0)", "golden_cross": "coalesce(sma_50 > sma_200, false)::INT", "doji": "doji", "hammer": "hammer", "engulfing": "engulfing",
    "log_return": "log_return", "volatility_20": "vol * sqrt(252)", "stoch_k": "stoch_k", "stoch_d": "stoch_d",
}
FLAGS = ("golden_cross", "doji", "hammer", "engulfing")


# The suite of the price branch, complete rows only
@query(
    "win_suite_complete",
    "WITH RECURSIVE "
    + with_bars(
        f"SELECT * FROM (SELECT ticker, date, {', '.join(f'{x} AS {c}' if c in FLAGS else f'round({x}, 6) AS {c}' for c, x in SUITE.items())} FROM y JOIN e USING (ticker, pos) JOIN g USING (ticker, pos)) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SUITE)}",
        f"b AS (SELECT *, row_number() OVER {W} AS pos, lag(close) OVER {W} AS c0, lag(open) OVER {W} AS o0 FROM bars)",
        "x AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(close - c0, 0) END AS gain, CASE WHEN c0 IS NOT NULL THEN greatest(c0 - close, 0) END AS loss, greatest(high - low, abs(high - c0), abs(low - c0)) AS tr, ln(close / c0) AS log_return FROM b)",
        recursion(SUITE_STEPS),
        "k AS (SELECT ticker, pos, ema_12 - ema_26 AS v FROM e)",
        "g AS (SELECT ticker, pos, v AS sig FROM k WHERE pos = 1 UNION ALL SELECT k.ticker, k.pos, g.sig + 0.2 * (k.v - g.sig) FROM g JOIN k ON k.ticker = g.ticker AND k.pos = g.pos + 1)",
        f"""z AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in SUITE_SUMS.items())}, {mean_sql('close', 20, 'stddev_samp')} AS sd, {mean_sql('volume', 20)} AS volume_sma_20, {mean_sql('log_return', 20, 'stddev_samp')} AS vol,
  sum(CASE WHEN close - c0 >= 0 THEN volume ELSE -volume END) OVER {W} AS obv, sum((high + low + close) / 3 * volume) OVER {W} / nullif(sum(volume) OVER {W}, 0) AS vwap,
  100 * (close - {mean_sql('low', 14, 'min')}) / ({mean_sql('high', 14, 'max')} - {mean_sql('low', 14, 'min')} + 1e-10) AS stoch_k,
  (abs(close - open) / (high - low + 1e-10) < 0.1)::INT AS doji, (least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open))::INT AS hammer, coalesce(close > open AND c0 < o0 AND close > o0 AND open < c0, false)::INT AS engulfing FROM x)""",
        f"y AS (SELECT *, {mean_sql('stoch_k', 3)} AS stoch_d FROM z)",
    )[len("WITH ") :],
)
def win_suite_complete(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.suite(bars(spark, d)), *SUITE)


# Batches of whole dates in an order by hash
@query("ord_date_batches", with_bars("SELECT i // 8 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY md5(date::VARCHAR || '7'), date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) GROUP BY batch"))
def ord_date_batches(spark: SparkSession, d: str) -> DataFrame:
    days = bars(spark, d).select("date").distinct()
    i = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("date").cast("string"), F.lit("7"))), "date")) - 1
    return days.select(F.floor(i / 8).cast("long").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


# What a cache of 500 keeps
@query("ord_cache_kept", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def ord_cache_kept(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


# F7, F8, F12
@query("fn_scores", sql("SELECT doc_id, round(p2 - p0, 6) AS score, round(CASE WHEN conf >= 0.5 THEN greatest(least(0.5 * (p2 - p0) / 0.04, 0.25), -0.25) ELSE 0 END, 6) AS gated FROM h", PRED, YHAT))
def fn_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p2") - F.col("p0")
    size = finance.fractional_kelly(s, F.lit(0.04), 0.5, 0.25)
    return predictions(spark, d).select("doc_id", F.round(s, 6).alias("score"), F.round(F.when(F.col("conf") >= 0.5, size).otherwise(0.0), 6).alias("gated"))


# cost of an order, with its least commission
@query("fn_execution_cost", "SELECT o_orderkey, round(greatest(o_totalprice * 0.001, 1.0) + o_totalprice * 0.0005 + o_totalprice * 0.1 * 0.02 * sqrt(o_totalprice / 1e7), 6) AS cost FROM orders")
def fn_execution_cost(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.greatest(p * 0.001, F.lit(1.0)) + p * 0.0005 + p * 0.1 * 0.02 * F.sqrt(p / 1e7), 6).alias("cost"))


# risk of an equal portfolio from the pairs' covariances
@query(
    "fn_portfolio_var",
    with_bars("SELECT round(1.645 * sqrt(sum(c) / pow(max(n), 2)), 6) AS var_95, round(max(CASE WHEN t1 <> t2 THEN rho END), 6) AS top_rho FROM (SELECT a.ticker AS t1, b.ticker AS t2, covar_samp(a.ret, b.ret) AS c, corr(a.ret, b.ret) AS rho, count(DISTINCT a.ticker) OVER () AS n FROM r a JOIN r b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.ticker, b.ticker)", RET),
)
def fn_portfolio_var(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d)).where("ret IS NOT NULL").select("date", "ticker", "ret")
    pairs = r.select("date", F.col("ticker").alias("t1"), F.col("ret").alias("x")).join(r.select("date", F.col("ticker").alias("t2"), F.col("ret").alias("y")), "date")
    c = pairs.groupBy("t1", "t2").agg(F.covar_samp("x", "y").alias("c"), F.corr("x", "y").alias("rho"))
    return c.agg(F.round(1.645 * F.sqrt(F.sum("c") / F.pow(F.countDistinct("t1"), 2)), 6).alias("var_95"), F.round(F.max(F.when(F.col("t1") != F.col("t2"), F.col("rho"))), 6).alias("top_rho"))


# Sharpe-like closed forms with the population's deviation
@query("fn_sharpe_population", with_bars("SELECT round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(52), 6) AS sharpe, round(avg(ret) * 52 / nullif((SELECT max(1 - e / p) FROM (SELECT e, greatest(max(e) OVER (ORDER BY date), 1) AS p FROM (SELECT date, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS e FROM m))), 0), 6) AS calmar FROM m", MARKET))
def fn_sharpe_population(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.drawdown(market(spark, d), "ret", "date")
    return m.agg(F.round(F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * F.sqrt(F.lit(52.0)), 6).alias("sharpe"), F.round(F.avg("ret") * 52 / F.nullif(F.max("drawdown"), F.lit(0.0)), 6).alias("calmar"))


# A period's word as days back from the last date
@query("fn_period_start", with_bars("SELECT p AS period, ((SELECT max(date) FROM bars) - CASE p WHEN '1mo' THEN 30 WHEN '6mo' THEN 180 ELSE 365 END)::DATE AS since FROM (SELECT unnest(['1mo', '6mo', '1y']) AS p)"))
def fn_period_start(spark: SparkSession, d: str) -> DataFrame:
    last = bars(spark, d).agg(F.max("date").alias("last"))
    each = last.select("last", F.expr("stack(3, '1mo', 30, '6mo', 180, '1y', 365) AS (period, days)"))
    return each.select("period", F.date_sub("last", F.col("days")).alias("since"))


# ST2: in batch, ticks older than their key's newest bucket so far
@query(
    "st_late_ticks",
    "SELECT event_type, count(*) AS late FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS b, max(time_bucket(INTERVAL 1 HOUR, ts)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events) WHERE b < newest GROUP BY event_type",
)
def st_late_ticks(spark: SparkSession, d: str) -> DataFrame:
    b = F.date_trunc("hour", "ts")
    before = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, d).withColumn("b", b).withColumn("newest", F.max("b").over(before))
    return e.where("b < newest").groupBy("event_type").agg(F.count(F.lit(1)).alias("late"))


# ST4, ST19: progress of a stream by key: ticks, names and the first ten of them; state is a row a key and name
@query("st_status", "SELECT event_type, sum(n)::BIGINT AS n, count(*) AS users, array_to_string(list(user_id ORDER BY user_id)[:10], ',') AS first_users FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def st_status(spark: SparkSession, d: str) -> DataFrame:
    each = candles.finished(candles.ticks(spark, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")), "complete")
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))
    first = F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= 10, F.col("user_id")))), ",")
    return each.withColumn("k", k).groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"), first.alias("first_users"))


# A logistic baseline, fitted before and scored after a date
@query("est_logistic_baseline")
def est_logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    b = ind.with_returns(bars(spark, d)).withColumns({"f1": lag(F.col("ret")), "f2": lag(F.col("ret"), 2), "label": (F.col("ret") > 0).cast("double")})
    rows = VectorAssembler(inputCols=["f1", "f2"], outputCol="features").transform(b.dropna(subset=["f1", "f2", "ret"]))
    cut = F.lit("2000-01-01").cast("date")
    fit = LogisticRegression(maxIter=20).fit(rows.where(F.col("date") < cut))
    scored = fit.transform(rows.where(F.col("date") >= cut))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))


# U4: a caller's own entity map
@query("udf_entity_map", r"SELECT doc_id, regexp_replace(text, '\bthe\b', '<TICKER_THE>', 'gi') AS marked FROM documents")
def udf_entity_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.mark_names(F.col("text"), {"the": "THE"}).alias("marked"))


# quantiles of the normal law on the driver
@query("stat_track_record_length", with_bars(f"SELECT round(1 + (1 - s * sr + (k - 1) / 4 * sr * sr) * pow({statistics.NormalDist().inv_cdf(0.95)!r} / sr, 2), 4) AS periods FROM sh", MARKET, SHARPE))
def stat_track_record_length(spark: SparkSession, d: str) -> DataFrame:
    m, z = metrics.sharpe_moments(market(spark, d), "ret"), statistics.NormalDist().inv_cdf(0.95)
    spread = 1 - F.col("s") * F.col("sr") + (F.col("k") - 1) / 4 * F.col("sr") * F.col("sr")
    return m.select(F.round(1 + spread * F.pow(z / F.col("sr"), 2), 4).alias("periods"))
