"""Queries of training objectives as metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objectives
from .catalog import query
from .metric_queries import PRED, YHAT, predictions
from .relational_queries import SIGNAL, signal, sql
from .window_queries import with_bars

WIDTHS = (0.4, 0.05)
TEMPERATURES = (0.1, 0.01)


# The kernel calibration error over all pairs of rows, at two widths of the kernel
@query(
    "agg_mmce",
    sql(
        "SELECT width, n, round(sqrt(greatest(total / (n * n), 1e-12)), 8) AS mmce FROM (SELECT width, (SELECT count(*) FROM h)::BIGINT AS n, sum((a.conf - (a.yhat = a.y)::INT) * (b.conf - (b.yhat = b.y)::INT) * exp(-abs(a.conf - b.conf) / width)) AS total FROM h a, h b, (SELECT unnest([0.4, 0.05])::DOUBLE AS width) GROUP BY width)",
        PRED,
        YHAT,
    ),
)
def agg_mmce(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    found = [objectives.calibration_error(p, F.col("conf"), F.col("yhat") == F.col("y"), w).withColumn("width", F.lit(w)) for w in WIDTHS]
    return found[0].unionByName(found[1]).select("width", "n", F.round("mmce", 8).alias("mmce"))


# Soft ranks of the score against ranks of the next return by date, at two temperatures
@query(
    "agg_soft_spearman",
    with_bars(
        """SELECT temperature, round(-avg(rho), 6) AS loss, count(*) AS n_groups FROM (SELECT temperature, date, covar_pop(soft, hard) * count(*) / greatest(sqrt(var_pop(soft) * var_pop(hard)) * count(*), 1e-12) AS rho FROM (
  SELECT temperature, a.date, a.ticker, any_value(a.hard) AS hard, 1 + sum(1 / (1 + exp((b.x - a.x) / temperature))) AS soft FROM v a JOIN v b ON a.date = b.date, (SELECT unnest([0.1, 0.01])::DOUBLE AS temperature) GROUP BY temperature, a.date, a.ticker) GROUP BY temperature, date) GROUP BY temperature""",
        *SIGNAL,
        "v AS (SELECT * FROM (SELECT date, ticker, x, row_number() OVER (PARTITION BY date ORDER BY next_ret, ticker) - 1 AS hard, count(*) OVER (PARTITION BY date) AS n FROM u WHERE x IS NOT NULL AND next_ret IS NOT NULL) WHERE n >= 5)",
    ),
)
def agg_soft_spearman(spark: SparkSession, d: str) -> DataFrame:
    df = signal(spark, d)
    found = [objectives.soft_spearman(df, "date", "ticker", "x", "next_ret", t).withColumn("temperature", F.lit(t)) for t in TEMPERATURES]
    return found[0].unionByName(found[1]).select("temperature", F.round("loss", 6).alias("loss"), "n_groups")
