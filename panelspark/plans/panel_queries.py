"""Further queries of panels: checks, warm-up, membership, summaries, pooling, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_ticker, lag, lead
from ..operators import indicators as ind
from ..sources.tables import bars, events, table
from .catalog import query
from .metric_queries import MARKET, PRED, market, predictions
from .relational_queries import SIGNAL, signal, sql
from .window_queries import RET, W, roll, rounded, with_bars


# Pruning and naming by file
@query("scan_by_file", "SELECT 'customer' AS file, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def scan_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Only files whose names match are listed and read."""
    files = spark.read.schema("c_nationkey int").option("pathGlobFilter", "{customer,supplier}.parquet").parquet(d)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(customer|supplier)\.parquet", 1)
    return files.select(name.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


# Positions of dates, warm-up dropped
@query("flt_warm_up", with_bars("SELECT ticker, date, round(close, 6) AS close FROM bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars)) USING (date) WHERE pos >= 60"))
def flt_warm_up(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    pos = b.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date"))).where("pos >= 60")
    return rounded(b.join(pos, "date", "left_semi"), "close")


# P10
@query("flt_strict_order", with_bars(f"SELECT ticker, bool_and(date > coalesce(d0, DATE '1900-01-01')) AS ordered, count(*) AS n FROM (SELECT ticker, date, lag(date) OVER {W} AS d0 FROM bars) GROUP BY ticker"))
def flt_strict_order(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("d0", lag(F.col("date")))
    return b.groupBy("ticker").agg(F.bool_and(F.col("date") > F.coalesce("d0", F.lit("1900-01-01").cast("date"))).alias("ordered"), F.count(F.lit(1)).alias("n"))


# Left join with zero for the missing
@query("join_left_zero", "SELECT c_custkey, coalesce(sum(o_totalprice), 0) AS total, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def join_left_zero(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"), F.count(F.lit(1)).alias("k"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("t", F.lit(0.0)).alias("total"), F.coalesce("k", F.lit(0)).alias("n"))


# Dates that all series have
@query("join_common_dates", with_bars("SELECT date, count(DISTINCT ticker) AS n FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)"))
def join_common_dates(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    want = b.agg(F.countDistinct("ticker").alias("want"))
    return b.groupBy("date").agg(F.countDistinct("ticker").alias("n")).join(F.broadcast(want), F.col("n") == F.col("want")).select("date", "n")


# A lookup of fixed size
@query("join_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS code FROM events")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for pair in {"click": 1, "view": 2, "purchase": 3}.items() for x in pair])
    return events(spark, d).select("event_id", F.coalesce(codes[F.col("event_type")], F.lit(0)).alias("code"))


# Sizes and entries of a universe
@query(
    "agg_membership",
    with_bars(
        "SELECT round(avg(n), 6) AS mean_size, min(n) AS least, max(n) AS most, (SELECT count(DISTINCT ticker) FROM m) AS names, (SELECT round(avg(e), 6) FROM (SELECT count(*) FILTER (WHERE d0 IS NULL OR d0 < pd) AS e FROM x GROUP BY date)) AS mean_entries FROM (SELECT date, count(*) AS n FROM m GROUP BY date)",
        "m AS (SELECT ticker, date FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS k FROM bars) WHERE k <= 5)",
        "p AS (SELECT date, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT DISTINCT date FROM m))",
        "x AS (SELECT m.ticker, m.date, lag(m.date) OVER (PARTITION BY m.ticker ORDER BY m.date) AS d0, coalesce(p.pd, DATE '1900-01-01') AS pd FROM m JOIN p USING (date))",
    ),
)
def agg_membership(spark: SparkSession, d: str) -> DataFrame:
    m = bars(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "ticker"))).where("k <= 5").select("ticker", "date")
    dates = m.select("date").distinct().withColumn("pd", F.coalesce(F.lag("date").over(Window.orderBy("date")), F.lit("1900-01-01").cast("date")))
    x = m.withColumn("d0", lag(F.col("date"))).join(dates, "date")
    each = x.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d0").isNull() | (F.col("d0") < F.col("pd"))).alias("e"))
    names = m.agg(F.countDistinct("ticker").alias("names"))
    return each.agg(F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("e"), 6).alias("mean_entries")).crossJoin(names)


# Mean by model, then over models
@query("agg_two_levels", sql("SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS seeds FROM (SELECT doc_id % 5 AS seed, avg(p2) AS m FROM pred GROUP BY seed)", PRED))
def agg_two_levels(spark: SparkSession, d: str) -> DataFrame:
    seeds = predictions(spark, d).groupBy((F.col("doc_id") % 5).alias("seed")).agg(F.avg("p2").alias("m"))
    return seeds.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.count(F.lit(1)).alias("seeds"))


# Last quote, change and range
@query("agg_quote_summary", with_bars(f"SELECT ticker, round(arg_max(close, date), 6) AS last, round(arg_max(close / c0 - 1, date), 6) AS change, round(max(high), 6) AS top, round(min(low), 6) AS bottom FROM (SELECT *, lag(close) OVER {W} AS c0, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 52 GROUP BY ticker"))
def agg_quote_summary(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumns({"c0": lag(F.col("close")), "k": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))}).where("k <= 52")
    return b.groupBy("ticker").agg(F.round(F.max_by("close", "date"), 6).alias("last"), F.round(F.max_by(F.col("close") / F.col("c0") - 1, F.col("date")), 6).alias("change"), F.round(F.max("high"), 6).alias("top"), F.round(F.min("low"), 6).alias("bottom"))


# The information coefficient's summary
@query(
    "agg_ic_summary",
    with_bars(
        "SELECT count(*) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg((ic > 0)::INT), 6) AS hit FROM (SELECT date, corr(x, next_ret) AS ic FROM u WHERE x IS NOT NULL AND next_ret IS NOT NULL GROUP BY date HAVING count(*) >= 5)",
        *SIGNAL,
    ),
)
def agg_ic_summary(spark: SparkSession, d: str) -> DataFrame:
    ic = signal(spark, d).where("x IS NOT NULL AND next_ret IS NOT NULL").groupBy("date").agg(F.corr("x", "next_ret").alias("ic"), F.count(F.lit(1)).alias("k")).where("k >= 5")
    return ic.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.stddev_samp("ic"), 6).alias("sd_ic"), F.round(F.avg("ic") / F.stddev_samp("ic"), 6).alias("icir"), F.round(F.avg((F.col("ic") > 0).cast("int")), 6).alias("hit"))


# Every k-th date, and chunks of whole dates
@query("win_every_fourth_date", with_bars("SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 4 = 0"))
def win_every_fourth_date(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.orderBy("date")) - 1
    return bars(spark, d).select("date").distinct().withColumn("i", i).where("i % 4 = 0").select("date")


# The last bar against its window
@query("win_window_zscore", with_bars(f"SELECT ticker, date, round((close - avg(close) OVER {roll(30)}) / (stddev_pop(close) OVER {roll(30)} + 1e-8), 6) AS z FROM bars"))
def win_window_zscore(spark: SparkSession, d: str) -> DataFrame:
    w = by_ticker().rowsBetween(-29, 0)
    return rounded(bars(spark, d).withColumn("z", (F.col("close") - F.avg("close").over(w)) / (F.stddev_pop("close").over(w) + 1e-8)), "z")


# The regime of the last bar
@query(
    "win_last_regime",
    with_bars(
        "SELECT ticker, CASE WHEN v > 0.9 THEN 'VOLATILE' WHEN close > m AND slow < m THEN 'BULL' WHEN close < m AND slow > m THEN 'BEAR' ELSE 'TRANSITIONAL' END AS regime FROM x WHERE k = 1",
        RET,
        f"x AS (SELECT ticker, close, avg(close) OVER {roll(20)} AS m, avg(close) OVER {roll(50)} AS slow, stddev_pop(ret) OVER {roll(20)} AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM r)",
    ),
)
def win_last_regime(spark: SparkSession, d: str) -> DataFrame:
    fast, slow = by_ticker().rowsBetween(-19, 0), by_ticker().rowsBetween(-49, 0)
    x = ind.with_returns(bars(spark, d)).withColumns({"m": F.avg("close").over(fast), "slow": F.avg("close").over(slow), "v": F.stddev_pop("ret").over(fast), "k": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))})
    c, m, s = F.col("close"), F.col("m"), F.col("slow")
    regime = F.when(F.col("v") > 0.9, "VOLATILE").when((c > m) & (s < m), "BULL").when((c < m) & (s > m), "BEAR").otherwise("TRANSITIONAL")
    return x.where("k = 1").select("ticker", regime.alias("regime"))


# Blocks of dates repeated up to the largest class
@query("smp_oversampled", sql("SELECT y, count(*) * (max(top) // count(*)) AS n FROM (SELECT y, max(c) OVER () AS top FROM (SELECT y, count(*) OVER (PARTITION BY y) AS c FROM pred)) GROUP BY y", PRED))
def smp_oversampled(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).select("y")
    counts = p.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    top = counts.agg(F.max("c").alias("top"))
    times = counts.crossJoin(top).select("y", F.floor(F.col("top") / F.col("c")).cast("int").alias("times"))
    more = p.join(F.broadcast(times), "y").select("y", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return more.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# O7
@query("ord_trending", with_bars(f"SELECT ticker, round(close / c0 - 1, 6) AS change FROM (SELECT *, lag(close) OVER {W} AS c0, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k = 1 ORDER BY ticker LIMIT 6"))
def ord_trending(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumns({"c0": lag(F.col("close")), "k": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))})
    return b.where("k = 1").orderBy("ticker").limit(6).select("ticker", F.round(F.col("close") / F.col("c0") - 1, 6).alias("change"))


# SP4, SP7: a last part behind an embargo
@query("split_embargo", with_bars("SELECT part, count(*) AS n FROM (SELECT CASE WHEN pos >= cut THEN 'val' WHEN pos + 5 < cut THEN 'train' END AS part FROM (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, floor(count(*) OVER () * 0.8) AS cut FROM (SELECT DISTINCT date FROM bars))) WHERE part IS NOT NULL GROUP BY part"))
def split_embargo(spark: SparkSession, d: str) -> DataFrame:
    days = bars(spark, d).select("date").distinct()
    cut = days.agg(F.floor(F.count(F.lit(1)) * F.lit(0.8)).alias("cut"))
    pos = days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1).crossJoin(cut)
    part = F.when(F.col("pos") >= F.col("cut"), "val").when(F.col("pos") + 5 < F.col("cut"), "train")
    return pos.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where("part IS NOT NULL")


# Calendar keys
@query("fn_calendar", "SELECT DISTINCT year(d) AS yr, month(d) AS mon, quarter(d) AS qtr, date_trunc('week', d)::DATE AS week, dayofweek(d) BETWEEN 1 AND 5 AS business FROM (SELECT ts::DATE AS d FROM events)")
def fn_calendar(spark: SparkSession, d: str) -> DataFrame:
    day = events(spark, d).select(F.to_date("ts").alias("d")).distinct()
    return day.select(F.year("d").cast("long").alias("yr"), F.month("d").cast("long").alias("mon"), F.quarter("d").cast("long").alias("qtr"), F.to_date(F.date_trunc("week", "d")).alias("week"), F.dayofweek("d").between(2, 6).alias("business")).distinct()


# Pooled vectors with a fallback
@query("fn_pooled_vectors", "SELECT label, round(list_sum(list_transform(range(1, 65), lambda i: abs(avg_i[i]))), 5) AS size FROM (SELECT label, list(a ORDER BY i) AS avg_i FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)")
def fn_pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    each = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return each.groupBy("label").agg(F.round(F.sum(F.abs("a")), 5).alias("size"))


# Fourier features of recency
@query("fn_recency", "SELECT event_id, round(sin(ln(1 + value) * 1.0), 6) AS s1, round(cos(ln(1 + value) * 0.1), 6) AS c2 FROM events WHERE value >= 0")
def fn_recency(spark: SparkSession, d: str) -> DataFrame:
    h = F.log1p("value")
    return events(spark, d).where("value >= 0").select("event_id", F.round(F.sin(h * 1.0), 6).alias("s1"), F.round(F.cos(h * 0.1), 6).alias("c2"))


# Baselines of momentum and of holding
@query("agg_baselines", with_bars("SELECT 'hold' AS model, round(avg(ret), 8) AS mean FROM m UNION ALL SELECT 'momentum', round(avg(sign(l) * ret), 8) FROM (SELECT ret, lag(ret) OVER (ORDER BY date) AS l FROM m) WHERE l IS NOT NULL", MARKET))
def agg_baselines(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d).withColumn("l", F.lag("ret").over(Window.orderBy("date")))
    hold = m.agg(F.lit("hold").alias("model"), F.round(F.avg("ret"), 8).alias("mean"))
    return hold.unionByName(m.where("l IS NOT NULL").agg(F.lit("momentum").alias("model"), F.round(F.avg(F.signum("l") * F.col("ret")), 8).alias("mean")))


# Features beside labels
@query("join_features_labels", with_bars(f"SELECT ticker, date, round(f, 6) AS f, round(y, 6) AS y FROM (SELECT ticker, date, ln(close / lag(close) OVER {W}) AS f FROM bars) JOIN (SELECT ticker, date, ln(lead(close, 3) OVER {W} / close) AS y FROM bars) USING (ticker, date) WHERE f IS NOT NULL AND y IS NOT NULL"))
def join_features_labels(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    f = b.select("ticker", "date", ind.log_return().alias("f")).where("f IS NOT NULL")
    y = b.select("ticker", "date", F.log(lead(F.col("close"), 3) / F.col("close")).alias("y")).where("y IS NOT NULL")
    return rounded(f.join(y, ["ticker", "date"]), "f", "y")
