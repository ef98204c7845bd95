"""Queries of provider payloads, universes, fallbacks, exports, subscription logs, losses and shrinkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_ticker, rolling
from ..operators import indicators as ind
from ..operators import inference, metrics
from ..sources import dumps, fetch, files, synthetic
from ..sources.tables import BARS_SQL, bars, events, table
from ..streaming import candles
from .catalog import query
from .metric_queries import MARKET, PRED, market, predictions
from .relational_queries import sql
from .study_queries import GRID, grid, normal_sql
from .window_queries import RET, W, roll, with_bars

HISTORY = "symbol string, historical array<struct<date: date, open: double, high: double, low: double, close: double, volume: double>>"


# A provider's history as JSON, a document a name, parsed into rows
@query("scan_json_history", with_bars("SELECT ticker, date, round(close, 6) AS close, volume::DOUBLE AS volume FROM bars WHERE volume > 0"))
def scan_json_history(spark: SparkSession, d: str) -> DataFrame:
    day = F.struct("date", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    payload = bars(spark, d).groupBy("ticker").agg(F.collect_list(day).alias("historical")).select(F.to_json(F.struct(F.col("ticker").cast("string").alias("symbol"), "historical")).alias("body"))
    parsed = payload.select(F.from_json("body", HISTORY).alias("b"))
    rows = parsed.select(F.col("b.symbol").cast("int").alias("ticker"), F.inline("b.historical"))
    return rows.where("volume > 0").select("ticker", "date", F.round("close", 6).alias("close"), "volume")


# Pages of at most 100 symbols, the first five of each exchange
@query("scan_symbol_pages", "SELECT exchange, page, symbol FROM (SELECT *, (row_number() OVER (PARTITION BY exchange ORDER BY symbol) - 1) // 100 AS page FROM (SELECT c_mktsegment AS exchange, c_custkey AS symbol FROM customer)) WHERE page < 5")
def scan_symbol_pages(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("exchange"), F.col("c_custkey").alias("symbol"))
    page = F.floor((F.row_number().over(Window.partitionBy("exchange").orderBy("symbol")) - 1) / 100)
    return names.withColumn("page", page).where("page < 5").select("exchange", "page", "symbol")


LISTINGS = "l AS (SELECT c_mktsegment AS market, upper(trim(split_part(c_name, '#', 1))) || (c_custkey % 40) || CASE c_custkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '' ELSE '.BO' END AS symbol, c_custkey AS place FROM customer)"


# Suffixes made one, first places kept in their order, a limit a market
@query(
    "scan_market_universe",
    sql("SELECT market, name, row_number() OVER (PARTITION BY market ORDER BY place) AS k FROM (SELECT market, regexp_replace(symbol, '\\.(NS|BO)$', '') || '.NS' AS name, min(place) AS place FROM l GROUP BY ALL) QUALIFY k <= 20", LISTINGS),
)
def scan_market_universe(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.when(key % 3 == 0, ".NS").when(key % 3 == 1, "").otherwise(".BO")
    raw = F.concat(F.upper(F.trim(F.split_part("c_name", F.lit("#"), F.lit(1)))), (key % 40).cast("string"), suffix)
    listed = table(spark, d, "customer").select(F.col("c_mktsegment").alias("market"), raw.alias("symbol"), key.alias("place"))
    name = F.concat(F.regexp_replace("symbol", r"\.(NS|BO)$", ""), F.lit(".NS"))
    first = listed.groupBy("market", name.alias("name")).agg(F.min("place").alias("place"))
    k = F.row_number().over(Window.partitionBy("market").orderBy("place"))
    return first.withColumn("k", k).where("k <= 20").select("market", "name", "k")


PROVIDERS = """pv AS (SELECT ticker, date, 1 AS rank, close AS price FROM bars WHERE ticker % 3 = 0 UNION ALL SELECT ticker, date, 2, close + 1 FROM bars WHERE ticker % 2 = 0 UNION ALL SELECT ticker, date, 3, 100 * exp(0.02 * z) FROM (SELECT *, {z} AS z FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars)))"""


# The first provider that has a price, synthetic ones where none has
@query(
    "scan_provider_fallback",
    with_bars("SELECT ticker, date, arg_min(rank, rank) AS provider, round(arg_min(price, rank), 6) AS price FROM pv GROUP BY ticker, date", PROVIDERS.format(z=normal_sql("q", "i", "ticker"))),
)
def scan_provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("i", F.row_number().over(by_ticker()) - 1)
    made = b.withColumn("price", 100 * F.exp(0.02 * synthetic.hashed_normal("q", "i", "ticker")))
    offers = [b.where("ticker % 3 = 0").select("ticker", "date", F.lit(1).alias("rank"), F.col("close").alias("price")), b.where("ticker % 2 = 0").select("ticker", "date", F.lit(2).alias("rank"), (F.col("close") + 1).alias("price")), made.select("ticker", "date", F.lit(3).alias("rank"), "price")]
    every = offers[0].unionByName(offers[1]).unionByName(offers[2])
    return every.groupBy("ticker", "date").agg(F.min("rank").alias("provider"), F.round(F.min_by("price", "rank"), 6).alias("price"))


# The newest twenty headlines of a user, a demo row where there is none
@query(
    "scan_news_or_demo",
    "SELECT c_custkey AS ticker, coalesce(n.event_id, -1) AS news_id, coalesce(n.value, 0.0) AS score FROM customer LEFT JOIN (SELECT * FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) n ON n.user_id = c_custkey",
)
def scan_news_or_demo(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    newest = events(spark, d).where("event_type = 'error'").withColumn("k", k).where("k <= 20").select(F.col("user_id").alias("ticker"), "event_id", "value")
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("ticker"))
    return names.join(newest.withColumn("ticker", F.col("ticker").cast("long")), "ticker", "left").select("ticker", F.coalesce("event_id", F.lit(-1)).cast("long").alias("news_id"), F.coalesce("value", F.lit(0.0)).alias("score"))


# A universe with its bars, indicators, news and profile; names that lack a part are marked, not dropped
@query(
    "snk_bulk_export",
    with_bars(
        """SELECT n_nationkey::INT AS ticker, n_name AS profile, coalesce(b.n_bars, 0) AS n_bars, round(b.last_sma, 6) AS last_sma, coalesce(e.n_news, 0) AS n_news, CASE WHEN b.n_bars IS NULL THEN 'no bars' WHEN e.n_news IS NULL THEN 'no news' ELSE 'ok' END AS status
FROM nation LEFT JOIN (SELECT ticker, count(*) AS n_bars, arg_max(s, date) AS last_sma FROM (SELECT ticker, date, CASE WHEN count(close) OVER """
        + roll(20)
        + " >= 20 THEN avg(close) OVER "
        + roll(20)
        + " END AS s FROM bars) GROUP BY ticker) b ON b.ticker = n_nationkey LEFT JOIN (SELECT user_id, count(*) AS n_news FROM events WHERE event_type = 'error' GROUP BY user_id) e ON e.user_id = n_nationkey"
    ),
)
def snk_bulk_export(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("s", ind.sma(F.col("close"), 20)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.max_by("s", "date").alias("last_sma"))
    n = events(spark, d).where("event_type = 'error'").groupBy(F.col("user_id").cast("int").alias("ticker")).agg(F.count(F.lit(1)).alias("n_news"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ticker"), F.col("n_name").alias("profile"))
    joined = names.join(b.withColumn("ticker", F.col("ticker").cast("int")), "ticker", "left").join(n, "ticker", "left")
    status = F.when(F.col("n_bars").isNull(), "no bars").when(F.col("n_news").isNull(), "no news").otherwise("ok")
    out = joined.select("ticker", "profile", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.round("last_sma", 6).alias("last_sma"), F.coalesce("n_news", F.lit(0)).alias("n_news"), status.alias("status"))
    return files.stored(out, "export")


# The report of a panel of random signals
@query(
    "rep_random_signals",
    f"""WITH {BARS_SQL}, s AS (SELECT date, s AS score, 0.02 * e AS fwd FROM (SELECT date, ticker, {normal_sql('0s', 'i', 'ticker')} AS s, {normal_sql('0n', 'i', 'ticker')} AS e FROM {GRID})),
i AS (SELECT date, corr(score, fwd) AS ic, avg(fwd) FILTER (WHERE score > 0) - avg(fwd) FILTER (WHERE score <= 0) AS spread FROM s GROUP BY date)
SELECT count(*) AS n, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg((ic > 0)::INT), 6) AS hit_rate, round(avg(spread), 8) AS spread FROM i""",
)
def rep_random_signals(spark: SparkSession, d: str) -> DataFrame:
    s, f = F.col("score"), F.col("fwd_ret")
    days = synthetic.signal_panel(grid(spark, d), 0.0).groupBy("date").agg(F.corr("score", "fwd_ret").alias("ic"), (F.avg(F.when(s > 0, f)) - F.avg(F.when(s <= 0, f))).alias("spread"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg("ic") / F.stddev_samp("ic"), 6).alias("icir"), F.round(F.avg((F.col("ic") > 0).cast("int")), 6).alias("hit_rate"), F.round(F.avg("spread"), 8).alias("spread"))


MARKET_NAMES = ("NYSE", "NASDAQ", "SP500")
DUMPED = "dp AS (SELECT ticker, ['NYSE', 'NASDAQ', 'SP500'][ticker % 3 + 1] AS market, date, open, high, low, close, volume FROM bars WHERE ticker % 7 <> 0)"


def dumped(spark: SparkSession, d: str) -> str:
    """The bars of six nations in seven as a dump; its folder."""
    path = files.scratch(spark, "dump")
    rows = bars(spark, d).where("ticker % 7 <> 0").withColumn("market", F.element_at(F.array(*map(F.lit, MARKET_NAMES)), F.col("ticker") % 3 + 1))
    dumps.write_dump(rows, path)
    return path


# A dump of statements, its files pruned by market and its rows by date
@query("scan_dump", with_bars("SELECT ticker::VARCHAR AS ticker, market, date, round(open, 6) AS open, round(close, 6) AS close, volume FROM dp WHERE market IN ('NYSE', 'SP500') AND date >= DATE '1995-01-01' AND date < DATE '1997-01-01'", DUMPED))
def scan_dump(spark: SparkSession, d: str) -> DataFrame:
    day = lambda text: F.lit(text).cast("date")
    rows = dumps.read_dump(spark, dumped(spark, d)).where(F.col("market").isin("NYSE", "SP500") & (F.col("date") >= day("1995-01-01")) & (F.col("date") < day("1997-01-01")))
    return rows.select("ticker", "market", "date", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume")


# Histories of all names from the dump, kept as a table; a name without files is told and passed over
@query(
    "scan_fetched_histories",
    with_bars("SELECT n_nationkey::INT AS ticker, date, round(close, 6) AS close, CASE WHEN date IS NULL THEN 'no history of ' || n_nationkey END AS error FROM nation LEFT JOIN dp ON ticker = n_nationkey AND volume > 0", DUMPED),
)
def scan_fetched_histories(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ticker"))
    path, source = files.scratch(spark, "histories"), dumps.history(dumped(spark, d))
    fetch.fetched_once(names, "ticker", source, path)
    return fetch.fetched_once(names, "ticker", source, path).select("ticker", "date", F.round("close", 6).alias("close"), "error")


# Texts as a data set, written and read back
@query("snk_text_dataset", "SELECT doc_id, lang, length(text) AS n FROM documents")
def snk_text_dataset(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "texts")
    files.write_texts(table(spark, d, "documents").select("doc_id", "lang", "text"), path, "documents")
    return spark.read.parquet(f"{path}/documents").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


# A demonstration equity curve over the weeks of the bars, and its figures
@query(
    "bt_demo_curve",
    f"WITH {BARS_SQL}, r AS (SELECT i, 0.0008 + 0.012 * {normal_sql('42d', 'i')} AS r FROM (SELECT row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars))), e AS (SELECT i, r, exp(sum(ln(1 + r)) OVER (ORDER BY i)) AS e FROM r) SELECT count(*) AS n, round(arg_max(e, i) - 1, 6) AS total_return, round(max(1 - e / m), 6) AS max_drawdown, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM (SELECT *, greatest(max(e) OVER (ORDER BY i), 1) AS m FROM e)",
)
def bt_demo_curve(spark: SparkSession, d: str) -> DataFrame:
    days = inference.placed(bars(spark, d).select("date").distinct(), "date").select(F.col("pos").alias("i")).withColumn("r", 0.0008 + 0.012 * synthetic.hashed_normal("42d", "i"))
    curve = metrics.drawdown(days, "r", "i")
    return curve.agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("equity", "i") - 1, 6).alias("total_return"), F.round(F.max("drawdown"), 6).alias("max_drawdown"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0)), 6).alias("sharpe"))


# ST12: a log of subscriptions as the state that it leaves, at most 64 names a socket, the earliest ones
@query(
    "st_subscriptions",
    "SELECT socket, ticker FROM (SELECT user_id % 7 AS socket, user_id AS ticker, arg_max(event_type IN ('click', 'view', 'purchase'), (ts, event_id)) AS live, max(ts) AS seen FROM events GROUP BY ALL) WHERE live QUALIFY row_number() OVER (PARTITION BY socket ORDER BY seen, ticker) <= 64",
)
def st_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    subscribes = F.col("event_type").isin("click", "view", "purchase")
    stream = candles.ticks(spark, d).groupBy((F.col("user_id") % 7).alias("socket"), F.col("user_id").alias("ticker")).agg(F.max_by(subscribes, F.struct("ts", "event_id")).alias("live"), F.max("ts").alias("at"))
    k = F.row_number().over(Window.partitionBy("socket").orderBy("at", "ticker"))
    return candles.finished(stream, "complete").where("live").withColumn("k", k).where("k <= 64").select("socket", "ticker")


# ST11: snapshots of the last quarter of an hour, merged
@query(
    "st_live_snapshots",
    "SELECT user_id AS ticker, count(DISTINCT event_type) AS workers, bool_or(event_type = 'signup') AS train FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 900 MINUTE GROUP BY user_id",
)
def st_live_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    live = e.crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 900 MINUTES"))
    return live.groupBy(F.col("user_id").alias("ticker")).agg(F.countDistinct("event_type").alias("workers"), F.bool_or(F.col("event_type") == "signup").alias("train"))


# ST21: the first thirty names of a registry, in upper case and once each
@query("ord_registry", "SELECT name FROM (SELECT upper(trim(c_mktsegment)) || (c_custkey % 90) AS name, min(c_custkey) AS place FROM customer GROUP BY name) ORDER BY place LIMIT 30")
def ord_registry(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.upper(F.trim("c_mktsegment")), (F.col("c_custkey") % 90).cast("string"))
    return table(spark, d, "customer").groupBy(name.alias("name")).agg(F.min("c_custkey").alias("place")).orderBy("place").limit(30).select("name")


OWN = "CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"


# Losses of a classifier and of a Gaussian head as metrics
@query(
    "agg_losses",
    sql(
        f"SELECT round(sum(w * -ln(own)) / sum(w), 6) AS weighted_ce, round(avg(w * -pow(1 - own, 2) * ln(own)), 6) AS focal, round(avg(0.5 * (lv + pow(y - mu, 2) * exp(-lv))), 6) AS gaussian_nll FROM (SELECT {OWN} AS own, y, p1 + 2 * p2 AS mu, ln(0.1 + p1) AS lv, w / (SELECT avg(w) FROM cw) AS w FROM pred JOIN cw USING (y))",
        PRED,
        "cw AS (SELECT y, sum(count(*)) OVER () / (3.0 * count(*)) AS w FROM pred GROUP BY y)",
    ),
)
def agg_losses(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    classes = p.groupBy("y").agg(F.count(F.lit(1)).alias("k"))
    w = F.sum("k").over(Window.partitionBy()) / (3.0 * F.col("k"))
    classes = classes.select("y", w.alias("w")).withColumn("w", F.col("w") / F.avg("w").over(Window.partitionBy()))
    own = F.element_at(F.array("p0", "p1", "p2"), F.col("y").cast("int") + 1)
    rows = p.join(F.broadcast(classes), "y").select("y", "w", own.alias("own"), (F.col("p1") + 2 * F.col("p2")).alias("mu"), F.log(0.1 + F.col("p1")).alias("lv"))
    ce = -F.log("own")
    gauss = 0.5 * (F.col("lv") + F.pow(F.col("y") - F.col("mu"), 2) * F.exp(-F.col("lv")))
    return rows.agg(F.round(F.sum(F.col("w") * ce) / F.sum("w"), 6).alias("weighted_ce"), F.round(F.avg(F.col("w") * F.pow(1 - F.col("own"), 2) * ce), 6).alias("focal"), F.round(F.avg(gauss), 6).alias("gaussian_nll"))


# The share of shrinkage towards a multiple of the identity, from sums over pairs and dates
@query(
    "stat_shrinkage",
    with_bars(
        """SELECT n, k, round(mu, 8) AS mu, round(least(greatest(b2, 0) / d2, 1), 6) AS share FROM (SELECT n, k, mu, (s2 - 2 * mu * mu * k + mu * mu * k) / k AS d2, (q / n - s2) / (n * k) AS b2 FROM
  (SELECT (SELECT count(DISTINCT date) FROM xc) AS n, (SELECT count(DISTINCT ticker) FROM xc) AS k, sum(c) FILTER (WHERE t1 = t2) / count(DISTINCT t1) AS mu, sum(c * c) AS s2, (SELECT sum(r2 * r2) FROM (SELECT sum(x * x) AS r2 FROM xc GROUP BY date)) AS q FROM (SELECT a.ticker AS t1, b.ticker AS t2, avg(a.x * b.x) AS c FROM xc a JOIN xc b USING (date) GROUP BY ALL)))""",
        RET,
        "xf AS (SELECT * FROM (SELECT ticker, date, ret, count(*) OVER (PARTITION BY date) AS k, (SELECT count(DISTINCT ticker) FROM r) AS names FROM r WHERE ret IS NOT NULL) WHERE k = names)",
        "xc AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM xf)",
    ),
)
def stat_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    r = ind.with_returns(bars(spark, d))
    names = r.select("ticker").distinct().count()
    full = r.where("ret IS NOT NULL").withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("k") == names)
    return metrics.shrinkage(full, "date", "ticker", "ret").select("n", "k", F.round("mu", 8).alias("mu"), F.round("share", 6).alias("share"))


# a position after the halt at a drawdown, the cap, the risk limit and the leverage, in turn
@query(
    "fn_risk_limits",
    with_bars(
        f"""SELECT ticker, date, round(CASE WHEN e / greatest(max(e) OVER {W}, 1) - 1 < -0.15 THEN 0 ELSE greatest(least(greatest(least(raw, 0.1), -0.1), coalesce(0.02 / nullif(1.645 * v, 0), 1)), -coalesce(0.02 / nullif(1.645 * v, 0), 1)) END, 6) AS position
FROM (SELECT ticker, date, ret * 2 AS raw, exp(sum(coalesce(ret, 0) / 10) OVER {W}) AS e, CASE WHEN count(ret) OVER {roll(21)} >= 10 THEN stddev_pop(ret) OVER {roll(21)} END AS v FROM r) WHERE raw IS NOT NULL""",
        RET,
    ),
)
def fn_risk_limits(spark: SparkSession, d: str) -> DataFrame:
    x = ind.with_returns(bars(spark, d))
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"raw": F.col("ret") * 2, "e": F.exp(F.sum(F.coalesce("ret", F.lit(0.0)) / 10).over(w)), "v": rolling(F.col("ret"), 21, F.stddev_pop, 10)}).where("raw IS NOT NULL")
    return x.select("ticker", "date", F.round(metrics.limited_position(F.col("raw"), F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1, F.col("v")), 6).alias("position"))
