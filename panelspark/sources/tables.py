"""Panels built from the relational tables: bars, news, sessions, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by nation: price is extended price over quantity, volume the quantity shipped.

    The supplier side is a dimension table; Spark broadcasts it below its own
    threshold.  The aggregate combines on the map side, 25 rows a week remain.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ticker"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        line.join(supplier, "l_suppkey")
        .groupBy("ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"))
    )


#: The same bars for the SQL oracles.
BARS_SQL = """bars AS (
  SELECT s_nationkey AS ticker, date_trunc('week', l_shipdate)::DATE AS date,
    arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
    sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: the time as TIMESTAMP, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with publication times: error events, the user as ticker."""
    return events(spark, sf_dir).where(F.col("event_type") == "error").select(F.col("event_id").alias("news_id"), F.col("user_id").alias("ticker"), F.col("ts").alias("published_at"), "value")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading sessions: days with events, opened 09:30 New York time; one row a day."""
    day = F.to_date("ts")
    open_ts = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("INTERVAL '9:30' HOUR TO MINUTE"), "America/New_York")
    return events(spark, sf_dir).select(day.alias("session")).distinct().withColumn("open_ts", open_ts)


SESSIONS_SQL = """sessions AS (
  SELECT session, ((session + INTERVAL '9 hours 30 minutes') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_ts
  FROM (SELECT DISTINCT ts::DATE AS session FROM events))"""
NEWS_SQL = "news AS (SELECT event_id AS news_id, user_id AS ticker, ts AS published_at, value FROM events WHERE event_type = 'error')"
