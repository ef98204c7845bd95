"""Resampling inference and selection tests as relations: resamples are rows, nothing is collected.

The stationary bootstrap draws its numbers from hashes of the resample and the
place, so that results do not hang on partitions and any SQL engine can repeat
them.  A resample is kept as the number of times that each place is drawn.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hashed_uniform(salt: str, *keys: str) -> Column:
    """A number in [0, 1) from the MD5 of the salt and the keys."""
    digest = F.md5(F.concat_ws("-", F.lit(salt), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def stationary_draws(spark: SparkSession, resamples: int, n: int, mean_block: float, seed: int = 0) -> DataFrame:
    """(resample, pos, times): blocks of geometric length, wrapped around."""
    rows = spark.range(resamples).select(F.col("id").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    fresh = (F.col("i") == 0) | (hashed_uniform(f"{seed}f", "resample", "i") < 1 / mean_block)
    start = F.floor(hashed_uniform(f"{seed}s", "resample", "i") * n)
    w = Window.partitionBy("resample").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    block = F.last(F.when(fresh, F.struct(F.col("i").alias("i"), start.alias("start"))), ignorenulls=True).over(w)
    placed = rows.withColumn("b", block).select("resample", F.pmod(F.col("b.start") + F.col("i") - F.col("b.i"), F.lit(n)).cast("int").alias("pos"))
    return placed.groupBy("resample", "pos").agg(F.count(F.lit(1)).alias("times"))


def placed(series: DataFrame, order: str) -> DataFrame:
    """Adds ``pos``, the place in time from 0; one row a date."""
    return series.withColumn("pos", (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))


def weighted_sharpe(x: str) -> Column:
    """Mean over sample deviation of x, drawn ``times`` times."""
    n, s, q = (F.sum(F.col("times") * v) for v in (F.lit(1.0), F.col(x), F.col(x) * F.col(x)))
    return s / n / F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(1e-24)))


def paired_difference(series: DataFrame, order: str, x: str, y: str, resamples: int, mean_block: float, statistic: Callable[[str], Column] = weighted_sharpe, seed: int = 0) -> DataFrame:
    """One row: diff, lo, hi (95 %), se and two-sided p of statistic(x) - statistic(y), both resampled alike."""
    at = placed(series, order)
    n = at.count()
    point = at.withColumn("times", F.lit(1)).agg((statistic(x) - statistic(y)).alias("diff"))
    draws = stationary_draws(series.sparkSession, resamples, n, mean_block, seed).join(at, "pos").groupBy("resample").agg((statistic(x) - statistic(y)).alias("d"))
    centre = F.avg("d").over(Window.partitionBy())
    both = draws.withColumn("c", F.col("d") - centre).crossJoin(F.broadcast(point))
    out = both.agg(F.first("diff").alias("diff"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.stddev_samp("d").alias("se"), F.avg((F.abs("c") >= F.abs("diff")).cast("double")).alias("p_value"))
    return out.withColumn("n", F.lit(n).cast("long"))


def default_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def best_of_many(f: DataFrame, order: str, model: str, gain: str, resamples: int, mean_block: float, studentised: bool, seed: int = 0) -> DataFrame:
    """One row: statistic, p_value, best_model, n_models, n_periods of a test that no model beats the benchmark.

    f: the benchmark's loss minus the model's, a row per date and model, all dates
    for every model.  Plain: White's reality check.  Studentised: Hansen's test, by
    long-run deviations, with models that are far behind left at their mean.
    """
    spark = f.sparkSession
    days = placed(f.select(order).distinct(), order)
    n = days.count()
    at = f.join(days, order).select("pos", F.col(model).alias("model"), F.col(gain).alias("f"))
    root = math.sqrt(n)
    if studentised:
        lags = min(default_lags(n), n - 1)
        dev = at.withColumn("d", F.col("f") - F.avg("f").over(Window.partitionBy("model")))
        w = Window.partitionBy("model").orderBy("pos")
        dev = dev.withColumns({f"p{k}": F.col("d") * (F.lag("d", k).over(w) if k else F.col("d")) for k in range(lags + 1)})
        lrv = F.sum("p0")
        for k in range(1, lags + 1):
            lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0))
        stats = dev.groupBy("model").agg(F.avg("f").alias("mean"), F.sqrt(F.greatest(lrv / n, F.lit(1e-12))).alias("omega"))
        far = -math.sqrt(2 * math.log(max(math.log(n), 1.0001)) / n)
        stats = stats.withColumn("centre", F.when(F.col("mean") >= F.col("omega") * far, F.col("mean")).otherwise(0.0))
    else:
        stats = at.groupBy("model").agg(F.avg("f").alias("mean")).withColumns({"omega": F.lit(1.0), "centre": F.col("mean")})
    floor = F.lit(0.0) if studentised else F.lit(-1e300)
    point = stats.agg(F.greatest(F.max(root * F.col("mean") / F.col("omega")), floor).alias("statistic"), F.max_by("model", F.struct(F.col("mean") / F.col("omega"), -F.col("model"))).alias("best_model"), F.count(F.lit(1)).alias("n_models"))
    draws = stationary_draws(spark, resamples, n, mean_block, seed).join(at, "pos").groupBy("resample", "model").agg((F.sum(F.col("times") * F.col("f")) / n).alias("boot"))
    top = draws.join(stats, "model").groupBy("resample").agg(F.greatest(F.max(root * (F.col("boot") - F.col("centre")) / F.col("omega")), floor).alias("top"))
    out = top.crossJoin(F.broadcast(point)).agg(F.first("statistic").alias("statistic"), F.avg((F.col("top") >= F.col("statistic")).cast("double")).alias("p_value"), F.first("best_model").alias("best_model"), F.first("n_models").alias("n_models"))
    return out.withColumn("n_periods", F.lit(n).cast("long"))


def overfitting_probability(returns: DataFrame, order: str, strategy: str, ret: str, blocks: int = 10) -> DataFrame:
    """One row: pbo, splits, strategies, periods, from all splits of the blocks into halves.

    Each strategy's sums over each block are made once; a split adds up sums of its
    blocks.  pbo is the share of splits whose best strategy in sample ranks in the
    lower half out of sample.
    """
    if blocks % 2:
        raise ValueError("a symmetric split needs an even number of blocks")
    days = placed(returns.select(order).distinct(), order)
    n = days.count()
    block = F.floor(((F.col("pos") + 1) * blocks - 1) / n).cast("int")
    sums = returns.join(days.select(order, block.alias("block")), order).groupBy("block", F.col(strategy).alias("s")).agg(F.count(ret).alias("k"), F.sum(ret).alias("x"), F.sum(F.col(ret) * F.col(ret)).alias("q"))
    splits = returns.sparkSession.range(1 << blocks).where(F.bit_count("id") == blocks // 2).select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    inside = F.call_function("shiftright", F.col("split"), F.col("block")).bitwiseAND(1) == 1
    halves = splits.withColumn("inside", inside).join(sums, "block").groupBy("split", "s", "inside").agg(F.sum("k").alias("k"), F.sum("x").alias("x"), F.sum("q").alias("q"))
    sd = F.sqrt(F.greatest((F.col("q") - F.col("x") * F.col("x") / F.col("k")) / (F.col("k") - 1), F.lit(0.0)))
    sharpe = F.when(sd > 1e-12, F.col("x") / F.col("k") / sd).otherwise(F.lit(float("-inf")))
    scored = halves.withColumn("sharpe", sharpe).groupBy("split", "s").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("seen"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("unseen"))
    best = scored.groupBy("split").agg(F.max_by("unseen", F.struct("seen", -F.col("s"))).alias("chosen"), F.count(F.lit(1)).alias("m"))
    ranks = scored.join(best, "split").groupBy("split").agg((F.count_if(F.col("unseen") < F.col("chosen")) + 1).alias("rank"), F.first("m").alias("m"))
    low = F.col("rank") / (F.col("m") + 1) <= 0.5
    return ranks.agg(F.avg(low.cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"), F.max("m").alias("strategies")).withColumn("periods", F.lit(n).cast("long"))


def capacity(adv: DataFrame, col: str, turnover: Column, cap: float = 0.01) -> DataFrame:
    """One row: the size at which trades reach ``cap`` of the daily value; null without turnover."""
    return adv.agg(F.when(turnover > 1e-12, F.sum(F.when(~F.isnan(col), F.col(col))) * cap / turnover).alias("capacity"))
