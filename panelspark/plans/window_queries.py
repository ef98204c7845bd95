"""Queries of window operators over weekly bars.  The id in each comment is the inventory's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recursive import smooth
from ..functions.rolling import by_ticker, cross_sectional_rank, lag, lead, ratio, rolling, running
from ..operators import indicators as ind
from ..operators import panels
from ..sources.tables import BARS_SQL, bars
from .catalog import query

W = "(PARTITION BY ticker ORDER BY date)"


def roll(n: int, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND {last})"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("ticker", "date", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes])


def with_bars(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BARS_SQL, *ctes]) + "\n" + body


RET = f"r AS (SELECT *, ln(close / lag(close) OVER {W}) AS ret FROM bars)"
#: A recursion by position, for the smoothing oracles: y = y + a (x - y) after the seed.
POS = f"p AS (SELECT *, row_number() OVER {W} AS pos FROM bars)"


# DM3, S3, A: weekly bars
@query("scan_bars", with_bars("SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"))
def scan_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d), "open", "high", "low", "close", "volume")


# W1
@query("win_sma", with_bars(f"SELECT ticker, date, round(CASE WHEN count(close) OVER {roll(20)} >= 20 THEN avg(close) OVER {roll(20)} END, 6) AS sma_20 FROM bars"))
def win_sma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).withColumn("sma_20", ind.sma(F.col("close"), 20)), "sma_20")


# W6
@query("win_true_range", with_bars(f"SELECT ticker, date, round(greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})), 6) AS tr FROM bars"))
def win_true_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).withColumn("tr", ind.true_range()), "tr")


def bollinger_sql(fn: str) -> str:
    return with_bars(
        "SELECT ticker, date, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_up, round(m - 2 * s, 6) AS bb_low, round((close - (m - 2 * s)) / nullif(m + 2 * s - (m - 2 * s), 0), 6) AS bb_pctb FROM b",
        f"b AS (SELECT *, CASE WHEN count(close) OVER {roll(20)} >= 20 THEN avg(close) OVER {roll(20)} END AS m, CASE WHEN count(close) OVER {roll(20)} >= 20 THEN {fn}(close) OVER {roll(20)} END AS s FROM bars)",
    )


# W8
@query("win_bollinger", bollinger_sql("stddev_pop"))
def win_bollinger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.bollinger(bars(spark, d)), "bb_mid", "bb_up", "bb_low", "bb_pctb")


# W38, W32
@query("win_bollinger_sample", bollinger_sql("stddev_samp"))
def win_bollinger_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.bollinger(bars(spark, d), sample=True), "bb_mid", "bb_up", "bb_low", "bb_pctb")


# W10, W11, W12
@query(
    "win_range_volatility",
    with_bars(
        f"""SELECT ticker, date,
  round(CASE WHEN count(g) OVER {roll(20)} >= 10 THEN sqrt(greatest(avg(g) OVER {roll(20)}, 0)) END, 6) AS gk_vol,
  round(CASE WHEN count(p) OVER {roll(20)} >= 10 THEN sqrt(avg(p) OVER {roll(20)} / (4 * ln(2))) END, 6) AS parkinson,
  round(CASE WHEN count(a) OVER {roll(20)} >= 10 THEN avg(a) OVER {roll(20)} END * 1e6, 6) AS amihud
FROM x""",
        RET,
        "x AS (SELECT *, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS g, pow(ln(high / low), 2) AS p, abs(ret) / nullif(close * volume, 0) AS a FROM r)",
    ),
)
def win_range_volatility(spark: SparkSession, d: str) -> DataFrame:
    df = ind.with_returns(bars(spark, d))
    return rounded(df.withColumns({"gk_vol": ind.garman_klass(), "parkinson": ind.parkinson(), "amihud": ind.amihud() * 1e6}), "gk_vol", "parkinson", "amihud")


# W13, W40
@query(
    "win_obv",
    with_bars(
        f"SELECT ticker, date, sum(coalesce(sign(close - c0), 0) * volume) OVER {W} AS obv, sum(CASE WHEN close - c0 >= 0 THEN 1.0 ELSE -1.0 END * volume) OVER {W} AS obv_pro FROM x",
        f"x AS (SELECT *, lag(close) OVER {W} AS c0 FROM bars)",
    ),
)
def win_obv(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumns({"s": F.coalesce(F.signum(F.col("close") - lag(F.col("close"))), F.lit(0.0)), "t": F.when(F.col("close") - lag(F.col("close")) >= 0, 1.0).otherwise(-1.0)})
    return rounded(df.withColumns({"obv": running(F.col("s") * F.col("volume")), "obv_pro": running(F.col("t") * F.col("volume"))}), "obv", "obv_pro")


# W41, W32
@query("win_vwap", with_bars(f"SELECT ticker, date, round(sum((high + low + close) / 3 * volume) OVER {W} / nullif(sum(volume) OVER {W}, 0), 6) AS vwap FROM bars"))
def win_vwap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).withColumn("vwap", ind.vwap()), "vwap")


# W42
@query(
    "win_stochastic",
    with_bars(
        f"SELECT ticker, date, round(k, 6) AS stoch_k, round(CASE WHEN count(k) OVER {roll(3)} >= 3 THEN avg(k) OVER {roll(3)} END, 6) AS stoch_d FROM s",
        f"s AS (SELECT *, CASE WHEN count(low) OVER {roll(14)} >= 14 THEN 100 * (close - min(low) OVER {roll(14)}) / nullif(max(high) OVER {roll(14)} - min(low) OVER {roll(14)}, 0) END AS k FROM bars)",
    ),
)
def win_stochastic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.stochastic(bars(spark, d)), "stoch_k", "stoch_d")


# W43
@query(
    "win_candlesticks",
    with_bars(
        """SELECT ticker, date, (abs(close - open) < 0.1 * (high - low))::INT AS doji,
  (least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open))::INT AS hammer,
  coalesce(c0 < o0 AND close > open AND open < c0 AND close > o0, false)::INT AS engulfing FROM x""",
        f"x AS (SELECT *, lag(open) OVER {W} AS o0, lag(close) OVER {W} AS c0 FROM bars)",
    ),
)
def win_candlesticks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.candlesticks(bars(spark, d)), "doji", "hammer", "engulfing")


# W44
@query(
    "win_trend",
    with_bars(
        f"""SELECT ticker, date, round(close / CASE WHEN count(close) OVER {roll(20)} >= 20 THEN avg(close) OVER {roll(20)} END - 1, 6) AS price_vs_sma,
  (CASE WHEN count(close) OVER {roll(10)} >= 10 THEN avg(close) OVER {roll(10)} END > CASE WHEN count(close) OVER {roll(50)} >= 50 THEN avg(close) OVER {roll(50)} END)::INT AS golden,
  round(volume / nullif(CASE WHEN count(volume) OVER {roll(20)} >= 20 THEN avg(volume) OVER {roll(20)} END, 0), 6) AS volume_ratio,
  round(CASE WHEN count(ret) OVER {roll(20)} >= 20 THEN stddev_samp(ret) OVER {roll(20)} END, 6) AS vol_20 FROM r""",
        RET,
    ),
)
def win_trend(spark: SparkSession, d: str) -> DataFrame:
    df = ind.with_returns(bars(spark, d))
    c, v = F.col("close"), F.col("volume")
    df = df.withColumns({"price_vs_sma": c / ind.sma(c, 20) - 1, "golden": (ind.sma(c, 10) > ind.sma(c, 50)).cast("int"), "volume_ratio": ratio(v, ind.sma(v, 20)), "vol_20": rolling(F.col("ret"), 20, F.stddev_samp)})
    return rounded(df, "price_vs_sma", "golden", "volume_ratio", "vol_20")


# W48
@query(
    "win_corwin_schultz",
    with_bars(
        "SELECT ticker, date, round(CASE WHEN h0 IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END, 6) AS cs_spread FROM y",
        f"x AS (SELECT *, lag(high) OVER {W} AS h0, lag(low) OVER {W} AS l0 FROM bars)",
        "y AS (SELECT *, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS alpha FROM (SELECT *, pow(ln(high / low), 2) + pow(ln(h0 / l0), 2) AS b, pow(ln(greatest(high, h0) / least(low, l0)), 2) AS g FROM x))",
    ),
)
def win_corwin_schultz(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars(spark, d).withColumn("cs_spread", ind.corwin_schultz()), "cs_spread")


def smooth_sql(value: str, alpha: str, n: int, first: int = 1, out: str = "y", source: str = "p") -> str:
    """CTE s(ticker, pos, y): seeded recursion over ``value`` from position ``first`` on."""
    seed = first + n - 1
    return f"""s_{out} AS (
  SELECT ticker, {seed}::BIGINT AS pos, avg({value}) AS {out} FROM {source} WHERE pos BETWEEN {first} AND {seed} GROUP BY ticker HAVING count({value}) = {n}
  UNION ALL
  SELECT s_{out}.ticker, x.pos, s_{out}.{out} + {alpha} * (x.{value} - s_{out}.{out}) FROM s_{out} JOIN {source} x ON x.ticker = s_{out}.ticker AND x.pos = s_{out}.pos + 1)"""


def recursive_bars(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BARS_SQL, *ctes]) + "\n" + body


# W2
@query("win_ema_seeded", recursive_bars("SELECT p.ticker, date, round(y, 6) AS ema_12 FROM p LEFT JOIN s_y USING (ticker, pos)", POS, smooth_sql("close", "2.0 / 13", 12)))
def win_ema_seeded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smooth(bars(spark, d), {"ema_12": ("close", "seeded", 2 / 13, 12)}), "ema_12")


# W37, W44, W55
@query("win_ema_ewm", recursive_bars("SELECT p.ticker, date, round(y, 6) AS ema_12 FROM p LEFT JOIN s_y USING (ticker, pos)", POS, smooth_sql("close", "2.0 / 13", 1)))
def win_ema_ewm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smooth(bars(spark, d), {"ema_12": ("close", "unseeded", 2 / 13, 0)}), "ema_12")


MOVES = f"m AS (SELECT *, greatest(close - c0, 0) AS gain, greatest(c0 - close, 0) AS loss FROM (SELECT *, lag(close) OVER {W} AS c0 FROM p))"


# W3, W4
@query(
    "win_rsi_ta",
    recursive_bars(
        "SELECT p.ticker, date, round(CASE WHEN l IS NOT NULL THEN coalesce(100 - 100 / (1 + g / nullif(l, 0)), 100) END, 6) AS rsi FROM p LEFT JOIN s_g USING (ticker, pos) LEFT JOIN s_l USING (ticker, pos)",
        POS,
        MOVES,
        smooth_sql("gain", "1.0 / 14", 14, 2, "g", "m"),
        smooth_sql("loss", "1.0 / 14", 14, 2, "l", "m"),
    ),
)
def win_rsi_ta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.rsi(bars(spark, d)), "rsi")


# W36
@query(
    "win_rsi_ewm",
    recursive_bars(
        "SELECT p.ticker, date, round(coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50), 6) AS rsi FROM p LEFT JOIN s_g USING (ticker, pos) LEFT JOIN s_l USING (ticker, pos)",
        POS,
        MOVES,
        smooth_sql("gain", "1.0 / 14", 1, 2, "g", "m"),
        smooth_sql("loss", "1.0 / 14", 1, 2, "l", "m"),
    ),
)
def win_rsi_ewm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.rsi(bars(spark, d), kind="unseeded"), "rsi")


# W5
@query(
    "win_macd_ta",
    recursive_bars(
        "SELECT p.ticker, date, round(f - w, 6) AS macd, round(q, 6) AS macd_signal, round(f - w - q, 6) AS macd_hist FROM p LEFT JOIN s_f USING (ticker, pos) LEFT JOIN s_w USING (ticker, pos) LEFT JOIN s_q USING (ticker, pos)",
        POS,
        smooth_sql("close", "2.0 / 13", 12, out="f"),
        smooth_sql("close", "2.0 / 27", 26, out="w"),
        "k AS (SELECT ticker, pos, f - w AS v FROM s_f JOIN s_w USING (ticker, pos))",
        smooth_sql("v", "2.0 / 10", 9, 26, "q", "k"),
    ),
)
def win_macd_ta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.macd(bars(spark, d)), "macd", "macd_signal", "macd_hist")


# W37
@query(
    "win_macd_ewm",
    recursive_bars(
        "SELECT p.ticker, date, round(f - w, 6) AS macd, round(q, 6) AS macd_signal, round(f - w - q, 6) AS macd_hist FROM p LEFT JOIN s_f USING (ticker, pos) LEFT JOIN s_w USING (ticker, pos) LEFT JOIN s_q USING (ticker, pos)",
        POS,
        smooth_sql("close", "2.0 / 13", 1, out="f"),
        smooth_sql("close", "2.0 / 27", 1, out="w"),
        "k AS (SELECT ticker, pos, f - w AS v FROM s_f JOIN s_w USING (ticker, pos))",
        smooth_sql("v", "2.0 / 10", 1, 1, "q", "k"),
    ),
)
def win_macd_ewm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.macd(bars(spark, d), kind="unseeded"), "macd", "macd_signal", "macd_hist")


TR = f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM p)"


# W7
@query("win_atr_ta", recursive_bars("SELECT p.ticker, date, round(y, 6) AS atr FROM p LEFT JOIN s_y USING (ticker, pos)", POS, TR, smooth_sql("tr", "1.0 / 14", 14, 2, "y", "t")))
def win_atr_ta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.atr(bars(spark, d)), "atr")


# W39
@query("win_atr_ewm", recursive_bars("SELECT p.ticker, date, round(y, 6) AS atr FROM p LEFT JOIN s_y USING (ticker, pos)", POS, TR, smooth_sql("tr", "1.0 / 14", 1, 1, "y", "t")))
def win_atr_ewm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.atr(bars(spark, d), kind="unseeded"), "atr")


SQUARES = f"q AS (SELECT *, pow(ln(close / lag(close) OVER {W}), 2) AS sq FROM p)"


# W9
@query("win_ewma_vol", recursive_bars("SELECT p.ticker, date, round(CASE WHEN pos >= 11 THEN sqrt(y) END, 6) AS ewma_vol FROM p LEFT JOIN s_y USING (ticker, pos)", POS, SQUARES, smooth_sql("sq", "2.0 / 21", 1, 2, "y", "q")))
def win_ewma_vol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.ewma_volatility(ind.with_returns(bars(spark, d))), "ewma_vol")


# W31
@query(
    "win_past_normalised",
    with_bars(
        f"""SELECT ticker, date, round(CASE WHEN n >= 20 THEN CASE WHEN s > 1e-8 THEN (close - m) / s ELSE 0 END END, 6) AS z,
  round(CASE WHEN n >= 20 THEN CASE WHEN hi - lo > 1e-8 THEN (close - lo) / (hi - lo) ELSE 0 END END, 6) AS mm
FROM (SELECT *, count(close) OVER w AS n, stddev_pop(close) OVER w AS s, avg(close) OVER w AS m, min(close) OVER w AS lo, max(close) OVER w AS hi
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
    ),
)
def win_past_normalised(spark: SparkSession, d: str) -> DataFrame:
    df = ind.past_normalised(bars(spark, d), "close", "z", 20)
    return rounded(ind.past_normalised(df, "close", "mm", 20, "minmax"), "z", "mm")


RANK = """k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) AS rk, count(x) OVER (PARTITION BY date, x) AS tied FROM u)"""


# W16, W17, W18
@query(
    "win_cross_sectional_rank",
    with_bars(
        "SELECT ticker, date, round(CASE WHEN x IS NOT NULL AND n >= 5 THEN (rk + (tied - 1) / 2.0 - 0.5) / n - 0.5 END, 6) AS rank_5 FROM k",
        RET,
        f"u AS (SELECT ticker, date, lag(f, 1) OVER {W} AS x FROM (SELECT *, ln(close / lag(close, 5) OVER {W}) AS f FROM r))",
        RANK,
    ),
)
def win_cross_sectional_rank(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("f", ind.log_return(5)).withColumn("x", lag(F.col("f")))
    return rounded(cross_sectional_rank(df, "x", "rank_5"), "rank_5")


# Momentum features, winsorised within the date
@query(
    "win_winsorised_momentum",
    with_bars(
        "SELECT ticker, date, round(CASE WHEN mom IS NOT NULL THEN greatest(least(mom, quantile_cont(mom, 0.99) OVER (PARTITION BY date)), quantile_cont(mom, 0.01) OVER (PARTITION BY date)) END, 6) AS mom, round(rev, 6) AS rev FROM u",
        RET,
        f"u AS (SELECT ticker, date, ln(lag(close, 4) OVER {W} / lag(close, 52) OVER {W}) AS mom, CASE WHEN count(ret) OVER {roll(5)} >= 3 THEN -sum(ret) OVER {roll(5)} END AS rev FROM r)",
    ),
)
def win_winsorised_momentum(spark: SparkSession, d: str) -> DataFrame:
    df = ind.with_returns(bars(spark, d))
    df = df.withColumns({"mom": F.log(lag(F.col("close"), 4) / lag(F.col("close"), 52)), "rev": -rolling(F.col("ret"), 5, F.sum, 3)})
    w = Window.partitionBy("date")
    low, high = (F.percentile("mom", F.lit(p)).over(w) for p in (0.01, 0.99))
    clipped = F.when(F.col("mom").isNotNull(), F.greatest(F.least("mom", high), low))
    return rounded(df.withColumn("clip", clipped).drop("mom").withColumnRenamed("clip", "mom"), "mom", "rev")


# W26, W29, W30
@query(
    "lbl_fixed_band",
    with_bars(
        """SELECT ticker, date, h AS horizon, CASE WHEN f IS NULL THEN NULL WHEN f > 0.01 THEN 2 WHEN f < -0.01 THEN 0 ELSE 1 END AS label
FROM (SELECT ticker, date, unnest([1, 4, 24]) AS h, unnest([f1, f4, f24]) AS f FROM x)""",
        f"x AS (SELECT *, lead(close, 1) OVER {W} / close - 1 AS f1, lead(close, 4) OVER {W} / close - 1 AS f4, lead(close, 24) OVER {W} / close - 1 AS f24 FROM bars)",
    ),
)
def lbl_fixed_band(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumns({f"f{h}": lead(F.col("close"), h) / F.col("close") - 1 for h in (1, 4, 24)})
    long = df.select("ticker", "date", F.expr("stack(3, 1, f1, 4, f4, 24, f24) AS (horizon, f)"))
    return long.select("ticker", "date", "horizon", panels.three_class(F.col("f"), F.lit(0.01)).alias("label"))


ABS = f"q AS (SELECT *, abs(ln(close / lag(close) OVER {W})) AS sq FROM p)"


# W25, W27
@query(
    "lbl_vol_scaled",
    recursive_bars(
        """SELECT ticker, date, round(f, 6) AS fwd_ret, CASE WHEN f IS NULL OR theta IS NULL THEN NULL WHEN f > theta THEN 2 WHEN f < -theta THEN 0 ELSE 1 END AS label
FROM (SELECT p.ticker, date, ln(lead(close, 5) OVER (PARTITION BY p.ticker ORDER BY date) / close) AS f,
  0.5 * sqrt(5) * lag(CASE WHEN p.pos >= 7 THEN y END) OVER (PARTITION BY p.ticker ORDER BY date) AS theta FROM p LEFT JOIN s_y USING (ticker, pos))""",
        POS,
        ABS,
        smooth_sql("sq", "2.0 / 21", 1, 2, "y", "q"),
    ),
)
def lbl_vol_scaled(spark: SparkSession, d: str) -> DataFrame:
    df = ind.with_returns(bars(spark, d)).withColumn("a", F.abs("ret"))
    df = smooth(df, {"v": ("a", "unseeded", 2 / 21, 6)})
    df = df.withColumns({"fwd_ret": panels.forward_return(5), "theta": 0.5 * F.sqrt(F.lit(5.0)) * lag(F.col("v"))})
    return rounded(df.withColumn("label", panels.three_class(F.col("fwd_ret"), F.col("theta"))), "fwd_ret", "label")


# W28
@query(
    "lbl_triple_barrier",
    with_bars(
        """SELECT ticker, date, CASE WHEN n < 5 THEN NULL WHEN i IS NULL OR (u AND w) THEN 1 WHEN u THEN 2 ELSE 0 END AS tb_label, CASE WHEN n = 5 THEN coalesce(i, 5) END AS tb_bars
FROM (SELECT a.ticker, a.date, count(b.pos) AS n, min(b.pos - a.pos) FILTER (WHERE b.high >= a.up OR b.low <= a.dn) AS i,
  arg_min(b.high >= a.up, b.pos) FILTER (WHERE b.high >= a.up OR b.low <= a.dn) AS u, arg_min(b.low <= a.dn, b.pos) FILTER (WHERE b.high >= a.up OR b.low <= a.dn) AS w
  FROM q a LEFT JOIN q b ON a.ticker = b.ticker AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 GROUP BY ALL)""",
        f"q AS (SELECT *, row_number() OVER {W} AS pos, close * exp(1.0) AS up, close * exp(-0.8) AS dn FROM bars)",
    ),
)
def lbl_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("theta", F.lit(1.0))
    return rounded(panels.triple_barrier(df, 5, 1.0, 0.8, "theta"), "tb_label", "tb_bars")


# On the positions of one ticker
LIVES = "x AS (SELECT ticker, pos, CASE WHEN pos + 5 <= n - 1 THEN pos + 5 END AS t1 FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars))"
ALIVE = "c AS (SELECT x.ticker, x.pos, count(y.pos) AS conc FROM x LEFT JOIN x y ON y.ticker = x.ticker AND y.t1 IS NOT NULL AND y.pos <= x.pos AND x.pos <= y.t1 GROUP BY ALL)"


def lives(spark: SparkSession, d: str) -> DataFrame:
    """Labels of five bars of every name; null where the bars end before."""
    pos = bars(spark, d).select("ticker", (F.row_number().over(by_ticker()) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("n"))
    return pos.select("ticker", "pos", F.when(F.col("pos") + 5 <= F.col("n") - 1, F.col("pos") + 5).alias("t1"))


@query("lbl_concurrency", with_bars("SELECT ticker, pos, conc FROM c", LIVES, ALIVE))
def lbl_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return panels.concurrency(lives(spark, d)).select("ticker", "pos", F.col("conc").cast("long").alias("conc"))


# W46, W47
@query("lbl_uniqueness", with_bars("SELECT x.ticker, x.pos, round(avg(1.0 / c.conc), 6) AS uniq FROM x JOIN c ON c.ticker = x.ticker AND c.pos BETWEEN x.pos AND x.t1 GROUP BY ALL", LIVES, ALIVE))
def lbl_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return panels.uniqueness(lives(spark, d)).select("ticker", "pos", F.round("uniq", 6).alias("uniq"))


# A38
@query("agg_effective_size", with_bars("SELECT ticker, count(*) AS labels, round(sum(u), 6) AS effective FROM (SELECT x.ticker, x.pos, avg(1.0 / c.conc) AS u FROM x JOIN c ON c.ticker = x.ticker AND c.pos BETWEEN x.pos AND x.t1 GROUP BY ALL) GROUP BY ticker", LIVES, ALIVE))
def agg_effective_size(spark: SparkSession, d: str) -> DataFrame:
    return panels.uniqueness(lives(spark, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("labels"), F.round(F.sum("uniq"), 6).alias("effective"))


# W33, DM5
@query("win_lookback_tensor", with_bars(f"SELECT ticker, date, round(list_sum(l), 6) AS total, len(l) AS n FROM (SELECT ticker, date, list(coalesce(ret, 0)) OVER {roll(12)} AS l FROM r)", RET))
def win_lookback_tensor(spark: SparkSession, d: str) -> DataFrame:
    df = ind.with_returns(bars(spark, d)).withColumn("w", F.collect_list(F.coalesce("ret", F.lit(0.0))).over(by_ticker().rowsBetween(-11, 0)))
    return df.select("ticker", "date", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("w").cast("long").alias("n"))


# W19, O2
@query(
    "win_liquidity_universe",
    with_bars(
        "SELECT date, ticker, round(adv, 6) AS adv, liq_rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY adv DESC, ticker) AS liq_rank FROM y WHERE adv IS NOT NULL AND p >= 500) WHERE liq_rank <= 10",
        f"x AS (SELECT *, lag(close * volume) OVER {W} AS dv, lag(close) OVER {W} AS p FROM bars)",
        f"y AS (SELECT *, CASE WHEN count(dv) OVER {roll(12)} >= 6 THEN quantile_cont(dv, 0.5) OVER {roll(12)} END AS adv FROM x)",
    ),
)
def win_liquidity_universe(spark: SparkSession, d: str) -> DataFrame:
    return panels.liquidity_universe(bars(spark, d), 12, 6, 500.0, 10).select("date", "ticker", F.round("adv", 6).alias("adv"), "liq_rank")


# Regimes from past returns and their own past volatility
@query(
    "win_regime",
    with_bars(
        """SELECT ticker, date, CASE WHEN n < 12 THEN NULL WHEN v > 1.5 * coalesce(past, v) THEN 'volatile' WHEN m > 0.02 THEN 'bull' WHEN m < -0.02 THEN 'bear' ELSE 'flat' END AS regime
FROM (SELECT *, avg(v) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM x)""",
        RET,
        "x AS (SELECT ticker, date, count(ret) OVER w AS n, avg(ret) OVER w AS m, CASE WHEN count(ret) OVER w >= 12 THEN stddev_pop(ret) OVER w END AS v FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
    ),
)
def win_regime(spark: SparkSession, d: str) -> DataFrame:
    w, past = by_ticker().rowsBetween(-12, -1), by_ticker().rowsBetween(Window.unboundedPreceding, -1)
    df = ind.with_returns(bars(spark, d)).withColumns({"n": F.count("ret").over(w), "m": F.avg("ret").over(w), "v": F.when(F.count("ret").over(w) >= 12, F.stddev_pop("ret").over(w))})
    regime = F.when(F.col("n") < 12, None).when(F.col("v") > 1.5 * F.coalesce(F.avg("v").over(past), F.col("v")), "volatile").when(F.col("m") > 0.02, "bull").when(F.col("m") < -0.02, "bear").otherwise("flat")
    return df.select("ticker", "date", regime.alias("regime"))


# W53, W54
@query(
    "win_chart_series",
    with_bars(
        "SELECT ticker, date, series, round(value, 6) AS value FROM (UNPIVOT (SELECT ticker, date, close, sma FROM x WHERE rn <= 60) ON close, sma INTO NAME series VALUE value)",
        f"x AS (SELECT ticker, date, close, CASE WHEN count(close) OVER {roll(20)} >= 20 THEN avg(close) OVER {roll(20)} END AS sma, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)",
    ),
)
def win_chart_series(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("sma", ind.sma(F.col("close"), 20)).withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("rn <= 60")
    long = df.select("ticker", "date", F.expr("stack(2, 'close', close, 'sma', sma) AS (series, value)")).where("value IS NOT NULL")
    return long.select("ticker", "date", "series", F.round("value", 6).alias("value"))
