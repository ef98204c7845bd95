"""Training objectives as metrics over all rows: exact, and without pairs of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the confidence, at least; each is a group of the scan.
BINS = 256
#: Largest exponent within a bin.
STEEPEST = 8.0
CHUNK = 512


def calibration_error(df: DataFrame, conf: Column, correct: Column, width: float = 0.4) -> DataFrame:
    """One row (mmce, n): the kernel calibration error sqrt(mean over all pairs of d_i d_j exp(-|c_i - c_j| / width)), d = c - correct.

    With the confidences (0 to 1) in order, the sum over earlier ones is
    exp(-c_i / width) times a running sum of d_j exp(c_j / width): a scan.  It runs in
    bins so narrow that no exponent leaves the range of doubles; a bin takes from those
    before it one number.  Equal confidences are summed before the scan, so many ties
    are one row.  Rows with a null are left out; fewer than two rows give 0.
    """
    bins = max(BINS, math.ceil(1 / (STEEPEST * width)))
    c, d = F.col("c"), F.col("d")
    rows = df.select(conf.cast("double").alias("c"), (conf.cast("double") - correct.cast("int")).alias("d")).where("c IS NOT NULL AND d IS NOT NULL")
    sums = rows.groupBy("c").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    bin_ = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    sums = sums.withColumn("bin", bin_).withColumn("e", (c - F.col("bin") / bins) / width)
    w = Window.partitionBy("bin").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    within = sums.withColumn("own", F.exp(-F.col("e")) * F.sum(d * F.exp("e")).over(w))
    # a bin's part of the sum: pairs within it, what its rows give to later bins, and what they take from earlier ones
    parts = within.groupBy("bin").agg(F.sum(d * (2 * F.col("own") - d)).alias("pairs"), F.sum(d * F.exp("e")).alias("gives"), F.sum(d * F.exp(-F.col("e"))).alias("takes"), F.sum("n").alias("n"))
    # at most ``bins`` rows, folded in their order
    folded = parts.agg(F.sort_array(F.collect_list(F.struct("bin", "pairs", "gives", "takes"))).alias("parts"), F.sum("n").alias("n"))
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0.0).alias("carry"), F.lit(0.0).alias("total"))

    def step(s: Column, p: Column) -> Column:
        # the carry at the start of bin p: of all rows before it
        carry = s["carry"] * F.exp(-(p["bin"] - s["bin"]) / (bins * width))
        return F.struct(p["bin"].alias("bin"), (carry + p["gives"]).alias("carry"), (s["total"] + p["pairs"] + 2 * p["takes"] * carry).alias("total"))

    total = F.aggregate("parts", start, step, lambda s: s["total"])
    n = F.coalesce("n", F.lit(0))
    return folded.select(F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(total / (n * n), F.lit(1e-12)))).alias("mmce"), n.alias("n"))


def soft_ranks(df: DataFrame, group: str, key: str, score: str, temperature: float) -> DataFrame:
    """(group, key, soft_rank): 1 + sum over the group's rows j of sigmoid((s - s_j) / temperature).

    Each group's scores are dealt into chunks of ``CHUNK`` by hash; a row meets its
    group's chunks as arrays, so a group of n rows makes n * n / CHUNK rows, spread over
    tasks by chunk, and the sum of a row over its chunks is combined before it is shuffled.
    """
    rows = df.select(group, key, F.col(score).cast("double").alias("s")).where(F.col("s").isNotNull())
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = rows.join(sizes, group).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    blocks = dealt.groupBy(group, "chunk").agg(F.collect_list("s").alias("others"))
    asked = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.aggregate("others", F.lit(0.0), lambda acc, s: acc + 1 / (1 + F.exp((s - F.col("s")) / temperature)))
    return asked.join(blocks, [group, "chunk"]).groupBy(group, key).agg((1 + F.sum(part)).alias("soft_rank"))


def soft_spearman(df: DataFrame, group: str, key: str, score: str, target: str, temperature: float = 0.1, least: int = 5) -> DataFrame:
    """One row (loss, n_groups): minus the mean over groups of the correlation of soft ranks of the score with ranks of the target.

    ``key`` is unique in a group and orders equal targets.  Rows with a null are left
    out, and then groups of fewer than ``least`` rows; without groups the loss is 0.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(group, key, score, target)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("_n") >= least).drop("_n")
    hard = rows.withColumn("hard", F.row_number().over(Window.partitionBy(group).orderBy(target, key)) - 1).select(group, key, "hard")
    both = soft_ranks(rows, group, key, score, temperature).join(hard, [group, key])
    a, b = F.col("soft_rank"), F.col("hard")
    norm = F.sqrt(F.var_pop(a) * F.var_pop(b)) * F.count(F.lit(1))
    each = both.groupBy(group).agg((F.covar_pop(a, b) * F.count(F.lit(1)) / F.greatest(norm, F.lit(1e-12))).alias("rho"))
    return each.agg(F.coalesce(-F.avg("rho"), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n_groups"))
