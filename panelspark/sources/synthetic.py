"""Synthetic values for the names and dates of a panel: numbers come from hashes where they are needed.

The same seed gives the same rows on any number of partitions, and any SQL engine
with MD5 can repeat them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.inference import hashed_uniform


def hashed_normal(salt: str, *keys: str) -> Column:
    """A standard normal number from two hashed ones (Box and Muller)."""
    u, v = hashed_uniform(salt + "a", *keys), hashed_uniform(salt + "b", *keys)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * np.pi * v)


def grid(panel: DataFrame) -> DataFrame:
    """(i, date, ticker): the rows of a panel, numbered by date for each name from 0."""
    return panel.select((F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("i"), "date", F.col("ticker").cast("int").alias("ticker"))


def random_walk(rows: DataFrame, seed: int = 0, sigma: float = 0.02) -> DataFrame:
    """(date, ticker, open, high, low, close, volume): independent walks from 100 over the rows of a grid."""
    rows = rows.withColumns({"z": hashed_normal(f"{seed}z", "i", "ticker"), "u": hashed_uniform(f"{seed}u", "i", "ticker"), "v": hashed_uniform(f"{seed}v", "i", "ticker")})
    w = Window.partitionBy("ticker").orderBy("i")
    rows = rows.withColumn("close", 100 * F.exp(F.sum(F.col("z") * sigma).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    spread = 1 + F.col("u") * sigma
    return rows.select("date", "ticker", "open", (F.greatest("open", "close") * spread).alias("high"), (F.least("open", "close") / spread).alias("low"), "close", F.floor(1e5 + 9e5 * F.col("v")).cast("double").alias("volume"))


def factor_panel(rows: DataFrame, seed: int = 0, omega: float = 2e-6, a: float = 0.08, b: float = 0.9) -> DataFrame:
    """(date, ticker, ret, sigma, close): a common factor and own noise whose variance follows its past; a name is one group."""
    rows = rows.withColumns({"f": hashed_normal(f"{seed}f", "i") * 0.008, "z": hashed_normal(f"{seed}e", "i", "ticker"), "beta": 0.5 + hashed_uniform(f"{seed}b", "ticker")})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        variance, own, sigma = omega / (1 - a - b), np.empty(len(part)), np.empty(len(part))
        for t, z in enumerate(part["z"].to_numpy()):
            sigma[t] = np.sqrt(variance)
            own[t] = sigma[t] * z
            variance = omega + a * own[t] ** 2 + b * variance
        ret = part["beta"].to_numpy() * part["f"].to_numpy() + own
        return pd.DataFrame({"date": part["date"].to_numpy(), "ticker": part["ticker"].to_numpy(), "ret": ret, "sigma": sigma, "close": 100 * np.exp(np.cumsum(ret))})

    return rows.groupBy("ticker").applyInPandas(run, "date date, ticker int, ret double, sigma double, close double")


def signal_panel(rows: DataFrame, strength: float, seed: int = 0) -> DataFrame:
    """(date, ticker, score, fwd_ret): scores whose correlation with the next return is ``strength``; 0: random signals."""
    s, e = hashed_normal(f"{seed}s", "i", "ticker"), hashed_normal(f"{seed}n", "i", "ticker")
    return rows.select("date", "ticker", s.alias("score"), (0.02 * (strength * s + np.sqrt(1 - strength**2) * e)).alias("fwd_ret"))


def leaky_panel(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A signal panel whose score is the next return itself: what a study must not be given."""
    return signal_panel(rows, 0.0, seed).withColumn("score", F.col("fwd_ret"))


#: Words of the synthetic headlines, by the sign of the return that they follow.
HEADLINES = {1: ("beats estimates", "record growth", "upgrade"), -1: ("misses estimates", "profit warning", "downgrade"), 0: ("holds meeting", "names director", "opens office")}


def headlines(panel: DataFrame, ret: str, threshold: float, seed: int = 0) -> DataFrame:
    """(ticker, published_at, headline): one for each row, which leans to the sign of a return beyond the threshold."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.floor(hashed_uniform(f"{seed}h", "ticker", "date") * len(words)) + 1).cast("int"))
    text = F.when(F.col(ret) > threshold, pick(HEADLINES[1])).when(F.col(ret) < -threshold, pick(HEADLINES[-1])).otherwise(pick(HEADLINES[0]))
    minute = F.floor(hashed_uniform(f"{seed}m", "ticker", "date") * 1440).cast("int")
    at = F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + minute * 60)
    return panel.select("ticker", at.alias("published_at"), F.concat(F.lit("T"), F.col("ticker").cast("string"), F.lit(" "), text).alias("headline"))
