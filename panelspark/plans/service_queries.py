"""Queries of provider payloads, file formats, request keys, fan-out, leases and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag
from ..operators import panels
from ..sources import files, providers
from ..sources.tables import bars, events, table
from ..streaming import candles, tunnels
from .catalog import query
from .metric_queries import MARKET, market
from .relational_queries import SIGNAL, signal
from .window_queries import W, with_bars

#: The bar of each week as a payload of one of three providers; every eleventh is broken.
QUOTED = f"qt AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'fmp' WHEN k % 3 = 1 THEN 'finnhub' ELSE 'yahoo' END AS ok FROM (SELECT *, ticker + date_diff('day', DATE '1992-01-01', date) AS k, lag(close) OVER {W} AS before FROM bars))"


# Payloads of three providers in their own forms, with change and currency
@query(
    "scan_quote_payloads",
    with_bars(
        """SELECT ticker, date, round(CASE WHEN ok IS NOT NULL THEN close END, 6) AS price, round(CASE WHEN ok IS NOT NULL THEN close - before END, 6) AS change, round(CASE WHEN ok IS NOT NULL THEN (close - before) / before * 100 END, 4) AS change_pct, CASE WHEN ok IN ('fmp', 'yahoo') THEN volume END AS volume,
  CASE ticker % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'GBP' END AS currency FROM qt""",
        QUOTED,
    ),
)
def scan_quote_payloads(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumns({"k": F.col("ticker") + F.date_diff("date", F.lit("1992-01-01").cast("date")), "before": lag(F.col("close"))})
    which = F.when(F.col("k") % 3 == 0, "fmp").when(F.col("k") % 3 == 1, "finnhub").otherwise("yahoo")
    change, pct = F.col("close") - F.col("before"), (F.col("close") - F.col("before")) / F.col("before") * 100
    as_json = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    fmp = as_json(symbol=F.col("ticker").cast("string"), price=F.col("close"), change=change, changesPercentage=pct, volume=F.col("volume"))
    finnhub, yahoo = as_json(c=F.col("close"), d=change, pc=F.col("before")), as_json(lastPrice=F.col("close"), previousClose=F.col("before"), lastVolume=F.col("volume"))
    payload = F.when(F.col("k") % 11 == 0, "{broken").when(which == "fmp", fmp).when(which == "finnhub", finnhub).otherwise(yahoo)
    place = F.element_at(F.array(F.lit("NYSE"), F.lit("nse"), F.lit("LSE")), F.col("ticker") % 3 + 1)
    rows = b.select("ticker", "date", place.alias("market"), providers.quote(which, payload).alias("q"))
    return rows.select("ticker", "date", F.round("q.price", 6).alias("price"), F.round("q.change", 6).alias("change"), F.round("q.change_pct", 4).alias("change_pct"), F.col("q.volume").alias("volume"), providers.currency(F.col("market")).alias("currency"))


# Profiles of all nations, with defaults where the payload is broken or tells nothing
@query(
    "scan_profile_default",
    """WITH p AS (SELECT n_nationkey AS ticker, any_value(n_name) AS name, any_value(r_name) AS country, round(sum(c_acctbal), 2) AS cap, any_value(n_nationkey % 5 = 0) AS broken, any_value(n_nationkey % 7 = 0) AS bare FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
SELECT ticker, CASE WHEN broken THEN ticker::VARCHAR ELSE name END AS company, CASE WHEN broken OR bare THEN 'Unknown' ELSE 'Sector of ' || country END AS sector, 'Unknown' AS industry, CASE WHEN broken THEN 'Unknown' ELSE country END AS country, CASE WHEN broken THEN 0.0 ELSE coalesce(cap, 0.0) END AS market_cap FROM p""",
)
def scan_profile_default(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    caps = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("cap"))
    rows = nations.join(caps, "n_nationkey", "left").withColumnRenamed("n_nationkey", "ticker")
    sector = F.when(F.col("ticker") % 7 == 0, " ").otherwise(F.concat(F.lit("Sector of "), "r_name"))
    payload = F.to_json(F.struct(F.col("n_name").alias("companyName"), sector.alias("sector"), F.col("r_name").alias("country"), F.col("cap").alias("mktCap")))
    told = rows.select("ticker", F.when(F.col("ticker") % 5 == 0, "no profile").otherwise(payload).alias("payload"))
    return providers.profiles(rows, "ticker", told, "payload")


# Bars through a CSV file, rows without volume left out
@query("scan_prices_csv", with_bars("SELECT ticker::VARCHAR AS ticker, date, round(open, 6) AS open, round(close, 6) AS close, volume::DOUBLE AS volume FROM bars WHERE volume > 0"))
def scan_prices_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "prices-csv")
    bars(spark, d).select("ticker", "date", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return files.prices_csv(spark, path).select("ticker", "date", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume")


# Whole texts as headlines through a CSV file, cleaned, the short ones left out
@query(
    "scan_news_csv",
    r"SELECT * FROM (SELECT source AS ticker, lang AS source, trim(regexp_replace(regexp_replace(text, '<[^>]+>|https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS headline FROM documents WHERE text IS NOT NULL) WHERE length(headline) > 10",
)
def scan_news_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "news-csv")
    rows = table(spark, d, "documents").select(F.col("source").alias("ticker"), F.timestamp_seconds(F.col("doc_id") * 60).alias("published_at"), F.col("lang").alias("source"), F.col("text").alias("headline"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.news_csv(spark, path).select("ticker", "source", "headline")


# Factors of a CSV file under their known names
@query("scan_factors_csv", with_bars("SELECT date, round(ret, 8) AS MKT, round(ret / 2, 8) AS SMB FROM m", MARKET))
def scan_factors_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "factors-csv")
    market(spark, d).select("date", F.col("ret").alias("mkt"), (F.col("ret") / 2).alias("Smb"), F.lit(1.0).alias("other")).write.option("header", True).csv(path)
    return files.factors_csv(spark, path).select("date", F.round("MKT", 8).alias("MKT"), F.round("SMB", 8).alias("SMB"))


# Bars as Parquet by ticker and year, and a year read back from its folders
@query("snk_prices_by_year", with_bars("SELECT ticker, date, round(close, 6) AS close FROM bars WHERE year(date) = 1996"))
def snk_prices_by_year(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "prices")
    files.write_prices(bars(spark, d), path)
    return spark.read.parquet(path).where("year = 1996").select("ticker", "date", F.round("close", 6).alias("close"))


# A directory of symbols, separated by bars, without its footer, of one exchange
@query("scan_symbols", "SELECT DISTINCT c_name AS symbol, c_mktsegment AS name FROM customer WHERE c_nationkey % 2 = 0")
def scan_symbols(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "symbols")
    rows = table(spark, d, "customer").select(F.col("c_name").alias("Symbol"), F.col("c_mktsegment").alias("Name"), F.when(F.col("c_nationkey") % 2 == 0, "N").otherwise("Q").alias("Exchange"))
    footer = spark.createDataFrame([("File Creation Time: 0101202400:00", None, None)], "Symbol string, Name string, Exchange string")
    rows.unionByName(rows).unionByName(footer).write.option("header", True).option("sep", "|").csv(path)
    return files.symbols(spark, path, "N").select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"))


KEYS, DAILY = 4, 80


# Requests dealt to keys in turn, each with so many a day
@query(
    "scan_key_rotation",
    f"""WITH e AS (SELECT ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events), c AS (SELECT day, coalesce(sum(least(count(*), {KEYS * DAILY})) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e GROUP BY day)
SELECT day, k::INT + 1 AS key_index, used, {DAILY} - used AS remaining, used >= {DAILY} AS exhausted, denied FROM (SELECT day, k, count(*) FILTER (WHERE n <= {KEYS * DAILY} AND (before + n - 1) % {KEYS} = k) AS used, count(*) FILTER (WHERE n > {KEYS * DAILY}) AS denied FROM e JOIN c USING (day), (SELECT unnest(range({KEYS})) AS k) GROUP BY day, k)""",
)
def scan_key_rotation(spark: SparkSession, d: str) -> DataFrame:
    asked = events(spark, d).select(F.to_date("ts").alias("day"), "ts", "event_id")
    granted = panels.dealt_to_keys(asked, "day", ["ts", "event_id"], KEYS, DAILY)
    used = granted.groupBy("day").agg(*[F.count_if(F.col("key_index") == k).alias(f"k{k}") for k in range(1, KEYS + 1)], F.count_if(F.col("key_index").isNull()).alias("denied"))
    each = used.select("day", "denied", F.explode(F.array(*[F.struct(F.lit(k).alias("key_index"), F.col(f"k{k}").alias("used")) for k in range(1, KEYS + 1)])).alias("u"))
    return each.select("day", "u.key_index", "u.used", (DAILY - F.col("u.used")).alias("remaining"), (F.col("u.used") >= DAILY).alias("exhausted"), "denied")


# ST9, ST13: messages to all instances that subscribe their name but the one that sent them, in chunks
@query(
    "st_fan_out",
    """WITH s AS (SELECT DISTINCT user_id, event_id % 5 AS instance FROM events WHERE event_type = 'view'), m AS (SELECT user_id, event_id, event_id % 5 AS sender FROM events WHERE event_type = 'purchase')
SELECT event_id, instance, (row_number() OVER (PARTITION BY event_id ORDER BY instance) - 1) // 2 AS chunk FROM m JOIN s USING (user_id) WHERE instance <> sender""",
)
def st_fan_out(spark: SparkSession, d: str) -> DataFrame:
    subscriptions = events(spark, d).where("event_type = 'view'").select("user_id", (F.col("event_id") % 5).alias("instance")).distinct()
    messages = candles.ticks(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", (F.col("event_id") % 5).alias("sender"))
    sent = candles.finished(messages.join(subscriptions, "user_id").where("instance <> sender").select("event_id", "instance"), "append")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("instance")) - 1
    return sent.select("event_id", "instance", F.floor(place / 2).alias("chunk"))


LEASE = 3 * 3600


# ST10: leases of locks: taken when free or run out, renewed by their holder, given back
@query(
    "st_leases",
    f"""WITH RECURSIVE r AS (SELECT user_id % 6 AS lock, (user_id // 6) % 4 AS worker, event_id, floor(epoch(ts))::BIGINT AS t, event_type = 'signup' AS leaves, row_number() OVER (PARTITION BY user_id % 6 ORDER BY floor(epoch(ts)), event_id) AS pos FROM events),
s AS (SELECT DISTINCT lock, 0::BIGINT AS pos, NULL::BIGINT AS holder, 0::BIGINT AS until, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::BIGINT AS worker FROM r
UNION ALL
SELECT lock, pos, CASE action WHEN 'released' THEN NULL WHEN 'acquired' THEN worker ELSE holder END, CASE WHEN action IN ('acquired', 'renewed') THEN t + {LEASE} ELSE until END, event_id, action, worker
FROM (SELECT s.lock, r.pos, r.event_id, r.worker, r.t, s.holder, s.until, CASE WHEN s.holder = r.worker AND r.t < s.until THEN CASE WHEN leaves THEN 'released' ELSE 'renewed' END WHEN (s.holder IS NULL OR r.t >= s.until) AND NOT leaves THEN 'acquired' END AS action FROM s JOIN r ON r.lock = s.lock AND r.pos = s.pos + 1))
SELECT lock, event_id, worker, action FROM s WHERE action IS NOT NULL""",
)
def st_leases(spark: SparkSession, d: str) -> DataFrame:
    asked = candles.ticks(spark, d).select((F.col("user_id") % 6).alias("lock"), F.floor(F.col("user_id") / 6 % 4).alias("worker"), "event_id", "ts", (F.col("event_type") == "signup").alias("leaves"))
    return candles.finished(tunnels.leases(asked, LEASE), "append")


# Scores projected onto weights within a cap that sum to nothing
@query(
    "fn_neutral_projection",
    "WITH RECURSIVE "
    + with_bars(
        "SELECT date, ticker, round(greatest(least(x - (low + high) / 2, 0.1), -0.1), 6) AS weight FROM v JOIN (SELECT * FROM s WHERE k = 60) USING (date)",
        *SIGNAL,
        "v AS (SELECT date, ticker, x FROM u WHERE x IS NOT NULL)",
        "l AS (SELECT date, list(x) AS xs FROM v GROUP BY date)",
        """s AS (SELECT date, xs, 0 AS k, list_min(xs) - 0.2 AS low, list_max(xs) + 0.2 AS high FROM l UNION ALL
SELECT date, xs, k + 1, CASE WHEN total > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN total > 0 THEN high ELSE (low + high) / 2 END FROM (SELECT *, list_sum(list_transform(xs, lambda x: greatest(least(x - (low + high) / 2, 0.1), -0.1))) AS total FROM s WHERE k < 60))""",
    )[len("WITH ") :],
)
def fn_neutral_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = signal(spark, d).where("x IS NOT NULL").select("date", "ticker", "x")
    return panels.neutral_projection(rows, "date", "x", 0.1).select("date", "ticker", F.round("weight", 6).alias("weight"))
