"""Causal indicators: every value at t reads rows up to t of its own ticker.

All share one partitioning by ticker and one order by date, so Spark plans one
exchange and one sort for any number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recursive import smooth
from ..functions.rolling import by_ticker, lag, ratio, rolling, running


def sma(x: Column, n: int) -> Column:
    return rolling(x, n, F.avg)


def true_range(first_null: bool = False) -> Column:
    before = lag(F.col("close"))
    full = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNull(), F.lit(None) if first_null else F.col("high") - F.col("low")).otherwise(full)


def log_return(n: int = 1) -> Column:
    return F.log(F.col("close") / lag(F.col("close"), n))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, sample: bool = False) -> DataFrame:
    """Middle, upper and lower band, and the place of the close between them (null for bands without width)."""
    c = F.col("close")
    middle, sd = rolling(c, n, F.avg), rolling(c, n, F.stddev_samp if sample else F.stddev_pop)
    df = df.withColumns({"bb_mid": middle, "bb_up": middle + k * sd, "bb_low": middle - k * sd})
    return df.withColumn("bb_pctb", ratio(c - F.col("bb_low"), F.col("bb_up") - F.col("bb_low")))


def garman_klass(n: int = 20) -> Column:
    daily = 0.5 * F.pow(F.log(F.col("high") / F.col("low")), 2) - (2 * math.log(2) - 1) * F.pow(F.log(F.col("close") / F.col("open")), 2)
    mean = rolling(daily, n, F.avg, n // 2)
    return F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0))))


def parkinson(n: int = 20) -> Column:
    return F.sqrt(rolling(F.pow(F.log(F.col("high") / F.col("low")), 2), n, F.avg, n // 2) / (4 * math.log(2)))


def amihud(n: int = 20) -> Column:
    return rolling(ratio(F.abs(F.col("ret")), F.col("close") * F.col("volume")), n, F.avg, n // 2)


def vwap() -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return ratio(running(typical * F.col("volume")), running(F.col("volume")))


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    low, high = rolling(F.col("low"), k, F.min), rolling(F.col("high"), k, F.max)
    df = df.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low))
    return df.withColumn("stoch_d", rolling(F.col("stoch_k"), d, F.avg))


def corwin_schultz() -> Column:
    """Spread from the highs and lows of two days, at least 0."""
    high, low = F.col("high"), F.col("low")
    one = F.pow(F.log(high / low), 2)
    beta = one + lag(one)
    gamma = F.pow(F.log(F.greatest(high, lag(high)) / F.least(low, lag(low))), 2)
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when(lag(high).isNotNull(), F.greatest(spread, F.lit(0.0)))


def candlesticks(df: DataFrame) -> DataFrame:
    """Doji, hammer and bullish engulfing flags."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - lo
    before_o, before_c = lag(o), lag(c)
    lower, upper = F.least(o, c) - lo, h - F.greatest(o, c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return df.withColumns(
        {
            "doji": flag(body < 0.1 * span),
            "hammer": flag((lower > 2 * body) & (upper < body)),
            "engulfing": flag((before_c < before_o) & (c > o) & (o < before_c) & (c > before_o)),
        }
    )


def moves(df: DataFrame) -> DataFrame:
    """Gains and losses of one step, null on the first row."""
    d = F.col("close") - lag(F.col("close"))
    return df.withColumns({"gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))}).withColumns({"gain": F.when(d.isNotNull(), F.col("gain")), "loss": F.when(d.isNotNull(), F.col("loss"))})


def rsi(df: DataFrame, n: int = 14, kind: str = "seeded") -> DataFrame:
    """Relative strength: seeded (100 without losses) or unseeded (50 without losses)."""
    df = smooth(moves(df), {"avg_gain": ("gain", kind, 1 / n, n if kind == "seeded" else 0), "avg_loss": ("loss", kind, 1 / n, n if kind == "seeded" else 0)})
    value = 100 - 100 / (1 + F.col("avg_gain") / F.nullif(F.col("avg_loss"), F.lit(0.0)))
    if kind == "seeded":
        value = F.when(F.col("avg_loss").isNotNull(), F.coalesce(value, F.lit(100.0)))
    else:
        value = F.coalesce(value, F.lit(50.0))
    return df.withColumn("rsi", value).drop("gain", "loss", "avg_gain", "avg_loss")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, kind: str = "seeded") -> DataFrame:
    a = lambda n: 2 / (n + 1)
    size = lambda n: n if kind == "seeded" else 0
    df = smooth(df, {"ema_fast": ("close", kind, a(fast), size(fast)), "ema_slow": ("close", kind, a(slow), size(slow))})
    df = smooth(df.withColumn("macd", F.col("ema_fast") - F.col("ema_slow")), {"macd_signal": ("macd", kind, a(signal), size(signal))})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("ema_fast", "ema_slow")


def atr(df: DataFrame, n: int = 14, kind: str = "seeded") -> DataFrame:
    """Seeded: the first true range is left out.  Unseeded: it is high minus low."""
    df = df.withColumn("tr", true_range(first_null=kind == "seeded"))
    return smooth(df, {"atr": ("tr", kind, 1 / n, n if kind == "seeded" else 0)}).drop("tr")


def ewma_volatility(df: DataFrame, span: int = 20) -> DataFrame:
    df = df.withColumn("_sq", F.pow(F.col("ret"), 2))
    return smooth(df, {"_v": ("_sq", "unseeded", 2 / (span + 1), max(span // 2, 2))}).withColumn("ewma_vol", F.sqrt("_v")).drop("_sq", "_v")


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", log_return())


def past_normalised(df: DataFrame, col: str, out: str, n: int, method: str = "zscore") -> DataFrame:
    """z-score or min-max against the n rows before the current one; 0 where they do not vary."""
    x = F.col(col)
    w = by_ticker().rowsBetween(-n, -1)
    if method == "zscore":
        sd = F.stddev_pop(x).over(w)
        value = F.when(sd > 1e-8, (x - F.avg(x).over(w)) / sd).otherwise(0.0)
    else:
        low, high = F.min(x).over(w), F.max(x).over(w)
        value = F.when(high - low > 1e-8, (x - low) / (high - low)).otherwise(0.0)
    return df.withColumn(out, F.when(F.count(x).over(w) >= n, value))


#: Periods of the suite's moving averages.
SUITE_PERIODS = (5, 10, 20, 50, 200)


def suite(df: DataFrame, periods: tuple[int, ...] = SUITE_PERIODS) -> DataFrame:
    """The price branch's indicators, a column each, on rows where all are known.

    The recursions go through one grouped map, the rest through windows that share
    its exchange: two stages for all columns.
    """
    c, high, low, o, v = (F.col(x) for x in ("close", "high", "low", "open", "volume"))
    before = lag(c)
    change = c - before
    df = df.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0)), "_tr": F.greatest(high - low, F.coalesce(F.abs(high - before), high - low), F.coalesce(F.abs(low - before), high - low))})
    df = df.withColumns({x: F.when(change.isNotNull(), F.col(x)) for x in ("_gain", "_loss")})
    means = {f"ema_{n}": ("close", "unseeded", 2 / (n + 1), 0) for n in sorted({*periods, 12, 26})}
    means |= {f"_{x}_{n}": (f"_{x}", "unseeded", 1 / n, 0) for n in (14, 21) for x in ("gain", "loss")} | {"atr_14": ("_tr", "unseeded", 1 / 14, 0)}
    df = smooth(df, means).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    df = smooth(df, {"macd_signal": ("macd", "unseeded", 2 / 10, 0)})
    rsi = lambda n: F.coalesce(100 - 100 / (1 + ratio(F.col(f"_gain_{n}"), F.col(f"_loss_{n}"))), F.lit(50.0))
    middle, sd = rolling(c, 20, F.avg), rolling(c, 20, F.stddev_samp)
    lowest, highest = rolling(low, 14, F.min), rolling(high, 14, F.max)
    df = df.withColumns({"log_return": log_return(), "volume_sma_20": rolling(v, 20, F.avg), "stoch_k": 100 * (c - lowest) / (highest - lowest + 1e-10), **{f"sma_{n}": sma(c, n) for n in periods}})
    body, under, over = F.abs(c - o), F.least(o, c) - low, high - F.greatest(o, c)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    df = df.withColumns(
        {
            "rsi_14": rsi(14), "rsi_21": rsi(21), "macd_hist": F.col("macd") - F.col("macd_signal"),
            "bb_mid": middle, "bb_upper": middle + 2 * sd, "bb_lower": middle - 2 * sd, "bb_width": ratio(4 * sd, middle), "bb_position": ratio(c - (middle - 2 * sd), 4 * sd),
            "obv": running(F.when(change >= 0, v).otherwise(-v)), "vwap": vwap(), "volume_ratio": ratio(v, F.col("volume_sma_20")),
            "price_vs_sma50": ratio(c - F.col("sma_50"), F.col("sma_50")), "price_vs_sma200": ratio(c - F.col("sma_200"), F.col("sma_200")), "golden_cross": flag(F.col("sma_50") > F.col("sma_200")),
            "doji": flag(body / (high - low + 1e-10) < 0.1), "hammer": flag((under >= 2 * body) & (over < body)), "engulfing": flag((c > o) & (before < lag(o)) & (c > lag(o)) & (o < before)),
            "volatility_20": rolling(F.col("log_return"), 20, F.stddev_samp) * math.sqrt(252), "stoch_d": rolling(F.col("stoch_k"), 3, F.avg),
        }
    )
    extra = [f"ema_{n}" for n in (12, 26) if n not in periods]
    return df.drop(*extra, *[x for x in df.columns if x.startswith("_")]).na.drop()
