"""Metrics of returns and of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def performance(df: DataFrame, ret: str, periods: int) -> DataFrame:
    """One row: annualised return and volatility, Sharpe, Sortino, skew, excess kurtosis, hit rate."""
    r = F.col(ret)
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    return df.agg(
        F.expm1(F.sum(F.log1p(r)) * periods / F.count(r)).alias("ann_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(periods)))).alias("ann_vol"),
        (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        (F.avg(r) / F.nullif(down, F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).alias("sortino"),
        F.kurtosis(r).alias("kurt"),
        F.avg(F.when(r != 0, (r > 0).cast("int"))).alias("hit_rate"),
    )


def sharpe_moments(df: DataFrame, ret: str) -> DataFrame:
    """One row: n, sr, s, k, se: the ratio of a period, bias-corrected skew and (not excess) kurtosis, and the ratio's standard error."""
    n = F.col("n").cast("double")
    a = df.agg(F.count(ret).alias("n"), (F.avg(ret) / F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("g1"), F.kurtosis(ret).alias("g2"))
    a = a.withColumns({"s": F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), "k": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3})
    variance = F.greatest(1 - F.col("s") * F.col("sr") + (F.col("k") - 1) / 4 * F.col("sr") * F.col("sr"), F.lit(1e-12))
    return a.select("n", "sr", "s", "k", F.sqrt(variance / (n - 1)).alias("se"))


def drawdown(df: DataFrame, ret: str, order: str) -> DataFrame:
    """Adds the compounded equity and its share below the running peak; one row a date."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.exp(F.sum(F.log1p(F.col(ret))).over(w)))
    return df.withColumn("drawdown", 1 - F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)))


def newey_west(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    """One row: mean, long-run variance (Bartlett weights) and t statistic of a series."""
    n, mean = F.count(x).over(Window.partitionBy()), F.avg(x).over(Window.partitionBy())
    dev = df.select(order, n.alias("n"), mean.alias("mean"), (F.col(x) - mean).alias("d"))
    products = [F.sum(F.col(f"p{lag}")) for lag in range(lags + 1)]
    dev = dev.withColumns({f"p{lag}": F.col("d") * (F.lag("d", lag).over(Window.orderBy(order)) if lag else F.col("d")) for lag in range(lags + 1)})
    total = products[0]
    for lag in range(1, lags + 1):
        total = total + 2 * (1 - lag / (lags + 1)) * products[lag]
    out = dev.agg(F.first("mean").alias("mean"), F.first("n").alias("n"), (total / F.first("n")).alias("lrv"))
    return out.withColumn("t_stat", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))


def calibration_bins(df: DataFrame, conf: Column, hit: Column, bins: int) -> DataFrame:
    """(bin, n, conf, acc): equal-width bins of the confidence, empty ones with nulls."""
    b = F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    filled = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("conf"), F.avg(hit.cast("int")).alias("acc"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def conformal_level(n: Column, alpha: float) -> Column:
    """1-based rank of the split-conformal quantile among n sorted scores ("higher")."""
    level = F.least(F.ceil((n + 1) * F.lit(1 - alpha)) / n, F.lit(1.0))
    return F.ceil(level * (n - 1)).cast("long") + 1


def shrinkage(df: DataFrame, order: str, name: str, ret: str) -> DataFrame:
    """One row: n dates, k names, mu and the share of shrinkage to mu times the identity (Ledoit and Wolf); all dates for every name."""
    x = df.select(order, name, (F.col(ret) - F.avg(ret).over(Window.partitionBy(name))).alias("x"))
    a, b = x.select(order, F.col(name).alias("t1"), F.col("x").alias("xa")), x.select(order, F.col(name).alias("t2"), F.col("x").alias("xb"))
    # the pairs of names are the covariance itself
    pairs = a.join(b, order).groupBy("t1", "t2").agg(F.avg(F.col("xa") * F.col("xb")).alias("c"))
    own = pairs.agg(F.countDistinct("t1").alias("k"), (F.sum(F.when(F.col("t1") == F.col("t2"), F.col("c"))) / F.countDistinct("t1")).alias("mu"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    days = x.groupBy(order).agg(F.sum(F.col("x") * F.col("x")).alias("r2")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r2") * F.col("r2")).alias("q"))
    n, k, mu = F.col("n"), F.col("k"), F.col("mu")
    far = (F.col("s2") - mu * mu * k) / k
    noise = (F.col("q") / n - F.col("s2")) / (n * k)
    return own.crossJoin(F.broadcast(days)).select("n", "k", "mu", F.when(far > 0, F.least(F.greatest(noise, F.lit(0.0)) / far, F.lit(1.0))).otherwise(0.0).alias("share"))


def limited_position(raw: Column, drawdown: Column, sd: Column, halt: float = 0.15, most: float = 0.1, var_limit: float = 0.02, leverage: float = 1.0) -> Column:
    """A position within all limits; 0 in a drawdown beyond the halt, no risk limit where the deviation is not known."""
    within = lambda x, cap: F.greatest(F.least(x, cap), -cap)
    by_risk = F.coalesce(var_limit / F.nullif(1.645 * sd, F.lit(0.0)), F.lit(float("inf")))
    return F.when(drawdown < -halt, 0.0).otherwise(within(within(within(raw, F.lit(most)), by_risk), F.lit(leverage)))
