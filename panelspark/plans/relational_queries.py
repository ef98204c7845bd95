"""Queries of scans, filters, joins, sets, splits and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag, lead
from ..operators import indicators as ind
from ..operators import panels
from ..sources.tables import NEWS_SQL, SESSIONS_SQL, bars, events, news, sessions, table
from .catalog import query
from .window_queries import RET, W, roll, rounded, with_bars


def sql(body: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# Date range, positive prices, projection
@query(
    "flt_positive_range",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' AND l_extendedprice > 0 AND l_quantity >= 10",
)
def flt_positive_range(spark: SparkSession, d: str) -> DataFrame:
    ship = F.col("l_shipdate")
    kept = (ship >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))) & (ship < F.to_timestamp_ntz(F.lit("1996-07-01 00:00:00"))) & (F.col("l_extendedprice") > 0) & (F.col("l_quantity") >= 10)
    return table(spark, d, "lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


# P2
@query("flt_minimum_history", with_bars("SELECT ticker, date, round(close, 6) AS close FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars) WHERE n >= 150"))
def flt_minimum_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.minimum_history(bars(spark, d), 150), "close")


# S18
@query("scan_clean_bars", with_bars(f"SELECT ticker, date, round(close, 6) AS close, coalesce(abs(close / lag(close) OVER {W} - 1) > 0.5, false) AS big_move FROM bars WHERE high >= low AND volume > 0"))
def scan_clean_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.clean_bars(bars(spark, d)), "close", "big_move")


# Keep-first and keep-last
@query("ord_keep_first", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem) WHERE n = 1")
def ord_keep_first(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return panels.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_extendedprice")


# A4, J10
@query("join_best_listing", "SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE k = 1")
def join_best_listing(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return panels.keep_first(counts, ["c_nationkey"], [F.desc("n"), F.col("c_mktsegment")])


# J1, D1, D2
@query(
    "join_asof_session",
    sql("SELECT news_id, session, round(epoch(open_ts - published_at) / 3600.0, 6) AS lag_hours FROM news ASOF LEFT JOIN sessions ON published_at + INTERVAL 24 HOUR <= open_ts", NEWS_SQL, SESSIONS_SQL),
)
def join_asof_session(spark: SparkSession, d: str) -> DataFrame:
    found = panels.calendar_asof(news(spark, d), F.col("published_at") + F.expr("INTERVAL 24 HOURS"), sessions(spark, d), "open_ts", ["session", "open_ts"])
    return found.select("news_id", "session", F.round((F.unix_micros("open_ts") - F.unix_micros("published_at")) / 3.6e9, 6).alias("lag_hours"))


# Strictly later event of the same user
@query("join_asof_strict", "SELECT e.event_id, min(p.ts) AS next_ts FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts WHERE e.event_type = 'click' GROUP BY e.event_id")
def join_asof_strict(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    right = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("next_ts")).agg(F.count(F.lit(1)).alias("n"))
    found = panels.forward_asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), F.col("ts"), right, "next_ts", ["next_ts"], ["user_id"], strict=True)
    return found.select("event_id", F.col("next_ts").cast("timestamp_ntz").alias("next_ts"))


# Alignment, lag window, the most recent per key
@query(
    "join_news_alignment",
    sql(
        "SELECT news_id, ticker, session, rk FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY lag_hours, news_id) - 1 AS rk FROM a WHERE lag_hours BETWEEN 24 - 1e-9 AND 72) WHERE rk < 8",
        NEWS_SQL,
        SESSIONS_SQL,
        "a AS (SELECT news_id, ticker, session, epoch(open_ts - published_at) / 3600.0 AS lag_hours FROM news ASOF JOIN sessions ON published_at + INTERVAL 24 HOUR <= open_ts)",
    ),
)
def join_news_alignment(spark: SparkSession, d: str) -> DataFrame:
    found = panels.calendar_asof(news(spark, d), F.col("published_at") + F.expr("INTERVAL 24 HOURS"), sessions(spark, d), "open_ts", ["session", "open_ts"])
    found = found.withColumn("lag_hours", (F.unix_micros("open_ts") - F.unix_micros("published_at")) / 3.6e9).where(F.col("lag_hours").between(24 - 1e-9, 72))
    rk = F.row_number().over(Window.partitionBy("ticker", "session").orderBy("lag_hours", "news_id")) - 1
    return found.withColumn("rk", rk).where("rk < 8").select("news_id", "ticker", "session", "rk")


# J3, O4
@query(
    "join_interval_news",
    sql(
        "SELECT ticker, date, news_id, k FROM (SELECT p.ticker, p.date, n.news_id, row_number() OVER (PARTITION BY p.ticker, p.date ORDER BY n.published_at DESC, n.news_id) AS k FROM p JOIN news n ON n.ticker = p.ticker AND n.published_at BETWEEN p.date - INTERVAL 72 HOUR AND p.date - INTERVAL 24 HOUR) WHERE k <= 5",
        NEWS_SQL,
        "p AS (SELECT DISTINCT user_id AS ticker, ts::DATE AS date FROM events)",
    ),
)
def join_interval_news(spark: SparkSession, d: str) -> DataFrame:
    dates = events(spark, d).select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).distinct()
    found = panels.interval_join(news(spark, d), dates, 72, 24)
    k = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("published_at"), "news_id"))
    return found.withColumn("k", k).where("k <= 5").select("ticker", "date", "news_id", "k")


# J17, SET2
@query(
    "join_index_membership",
    sql(
        "SELECT ticker, session FROM (SELECT c.ticker, s.session, arg_max(c.action, (c.effective_date, c.prio)) AS action FROM (SELECT DISTINCT ts::DATE AS session FROM events) s JOIN c ON c.effective_date <= s.session GROUP BY ALL) WHERE action = 'add'",
        "c AS (SELECT DISTINCT user_id AS ticker, ts::DATE AS effective_date, CASE WHEN event_type = 'signup' THEN 'add' ELSE 'remove' END AS action, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS prio FROM events WHERE event_type IN ('signup', 'error'))",
    ),
)
def join_index_membership(spark: SparkSession, d: str) -> DataFrame:
    add = F.col("event_type") == "signup"
    changes = events(spark, d).where("event_type IN ('signup', 'error')").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("effective_date"), F.when(add, "add").otherwise("remove").alias("action"), F.when(add, 1).otherwise(0).alias("prio")).distinct()
    return panels.membership(changes, sessions(spark, d).select("session"))


# Inner and semi joins
@query("join_semi_universe", with_bars("SELECT ticker, date, round(close, 6) AS close FROM bars WHERE ticker IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')"))
def join_semi_universe(spark: SparkSession, d: str) -> DataFrame:
    europe = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("ticker"))
    return rounded(bars(spark, d).join(europe, "ticker", "left_semi"), "close")


# J7, A1, A2
@query(
    "join_news_coverage",
    sql(
        "SELECT round(avg((n > 0)::INT), 6) AS share, round(avg(n), 6) AS mean_n, round(avg(CASE WHEN n > 0 THEN n END), 6) AS mean_if_any, max(n) AS max_n, count(*) AS n_rows FROM (SELECT k.ticker, k.date, count(w.news_id) AS n FROM k LEFT JOIN news w ON w.ticker = k.ticker AND w.published_at::DATE = k.date GROUP BY ALL)",
        NEWS_SQL,
        "k AS (SELECT DISTINCT user_id AS ticker, ts::DATE AS date FROM events)",
    ),
)
def join_news_coverage(spark: SparkSession, d: str) -> DataFrame:
    keys = events(spark, d).select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).distinct()
    counts = news(spark, d).groupBy("ticker", F.to_date("published_at").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    full = keys.join(counts, ["ticker", "date"], "left").select(n.alias("n"))
    any_ = F.col("n") > 0
    return full.agg(F.round(F.avg(any_.cast("int")), 6).alias("share"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.avg(F.when(any_, F.col("n"))), 6).alias("mean_if_any"), F.max("n").alias("max_n"), F.count(F.lit(1)).alias("n_rows"))


# J12, S15, S41, SET5: first source wins
@query("join_priority_merge", "SELECT key, arg_min(name, (prio, pos)) AS name FROM (SELECT s_nationkey AS key, s_name AS name, 1 AS prio, s_suppkey AS pos FROM supplier UNION ALL SELECT c_nationkey, c_name, 2, c_custkey FROM customer) GROUP BY key")
def join_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.lit(1).alias("prio"), F.col("s_suppkey").alias("pos"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.lit(2).alias("prio"), F.col("c_custkey").alias("pos"))
    return a.unionByName(b).groupBy("key").agg(F.min_by("name", F.struct("prio", "pos")).alias("name"))


# Hold a choice until the next rebalance
@query(
    "join_hold_forward",
    with_bars(
        "SELECT p.date, r.month_last AS held_since FROM (SELECT DISTINCT date FROM bars) p ASOF LEFT JOIN (SELECT max(date) AS month_last FROM bars GROUP BY date_trunc('month', date)) r ON r.month_last <= p.date"
    ),
)
def join_hold_forward(spark: SparkSession, d: str) -> DataFrame:
    dates = bars(spark, d).select("date").distinct()
    last = dates.withColumn("is_last", F.col("date") == F.max("date").over(Window.partitionBy(F.trunc("date", "month"))))
    # one row a date
    held = F.last(F.when(F.col("is_last"), F.col("date")), ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return last.select("date", held.alias("held_since"))


# SET1 to SET6
@query("set_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.where("event_type = 'click'").select("user_id").subtract(e.where("event_type = 'purchase'").select("user_id"))


@query("set_intersection", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("set_key_grid", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def set_key_grid(spark: SparkSession, d: str) -> DataFrame:
    # two dimension tables of fixed size
    return table(spark, d, "nation").select("n_nationkey").crossJoin(table(spark, d, "region").select("r_regionkey"))


# P8, SET3, SP6: ratio split by position, and its check
@query(
    "split_ratio",
    with_bars("SELECT part, count(*) AS n, min(date) AS lo, max(date) AS hi FROM (SELECT date, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))) GROUP BY part"),
)
def split_ratio(spark: SparkSession, d: str) -> DataFrame:
    days = bars(spark, d).select("date").distinct()
    n = days.agg(F.count(F.lit(1)).alias("n"))
    pos = days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1).crossJoin(n)
    part = F.when(F.col("pos") < F.floor(F.col("n") * F.lit(0.7)), "train").when(F.col("pos") < F.floor(F.col("n") * F.lit(0.85)), "val").otherwise("test")
    return pos.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))


# SP1, SP2, SP3, DM10
@query(
    "split_walk_forward",
    with_bars(
        """SELECT row_number() OVER (ORDER BY t) - 1 AS fold, t AS test_lo, least(t + 26, n) AS test_hi, t - 5 - emb - 26 AS val_lo, t - 5 - emb AS val_hi, 0::BIGINT AS train_lo, t - 5 - emb - 26 - 5 AS train_hi
FROM (SELECT n, emb, unnest(range(104 + 5 + 26 + 5 + emb, n, 26)) AS t FROM (SELECT count(*) AS n, ceil(count(*) * 0.01)::BIGINT AS emb FROM (SELECT DISTINCT date FROM bars)))"""
    ),
)
def split_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    folds = panels.walk_forward(bars(spark, d).select("date").distinct(), 5, 0.01, 104, 26, 26)
    return folds.select(*[F.col(c).cast("long").alias(c) for c in folds.columns])


# SP5: combinatorial purged splits, 6 groups choose 2
@query(
    "split_combinatorial",
    with_bars(
        """SELECT g1, g2, count(*) FILTER (WHERE in_test) AS n_test, count(*) FILTER (WHERE NOT in_test AND (pos + 5 < lo OR pos > hi + 4)) AS n_train
FROM (SELECT c.g1, c.g2, p.pos, p.g IN (c.g1, c.g2) AS in_test, min(CASE WHEN p.g IN (c.g1, c.g2) THEN p.pos END) OVER w AS lo, max(CASE WHEN p.g IN (c.g1, c.g2) THEN p.pos END) OVER w AS hi
  FROM p CROSS JOIN (SELECT a.range AS g1, b.range AS g2 FROM range(6) a JOIN range(6) b ON a.range < b.range) c WINDOW w AS (PARTITION BY c.g1, c.g2)) GROUP BY g1, g2""",
        "p AS (SELECT pos, ((pos + 1) * 6 - 1) // n AS g FROM (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)))",
    ),
)
def split_combinatorial(spark: SparkSession, d: str) -> DataFrame:
    days = bars(spark, d).select("date").distinct()
    pos = days.select((F.row_number().over(Window.orderBy("date")) - 1).alias("pos")).crossJoin(days.agg(F.count(F.lit(1)).alias("n")))
    pos = pos.withColumn("g", F.floor(((F.col("pos") + 1) * 6 - 1) / F.col("n")))
    a = spark.range(6)
    pairs = a.select(F.col("id").alias("g1")).join(a.select(F.col("id").alias("g2")), F.col("g1") < F.col("g2"))
    grid = pos.crossJoin(F.broadcast(pairs)).withColumn("in_test", (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))
    w = Window.partitionBy("g1", "g2")
    grid = grid.withColumns({"lo": F.min(F.when(F.col("in_test"), F.col("pos"))).over(w), "hi": F.max(F.when(F.col("in_test"), F.col("pos"))).over(w)})
    return grid.groupBy("g1", "g2").agg(F.count_if("in_test").alias("n_test"), F.count_if(~F.col("in_test") & ((F.col("pos") + 5 < F.col("lo")) | (F.col("pos") > F.col("hi") + 4))).alias("n_train"))


# Per group and in all
@query("agg_breadth_rollup", with_bars("SELECT ticker, count(*) FILTER (WHERE c > 0) AS up, count(*) FILTER (WHERE c < 0) AS down, round(avg(c), 6) AS mean_change FROM (SELECT ticker, close / lag(close) OVER " + W + " - 1 AS c FROM bars) GROUP BY ROLLUP (ticker)"))
def agg_breadth_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = bars(spark, d).withColumn("c", F.col("close") / lag(F.col("close")) - 1)
    return c.rollup("ticker").agg(F.count_if(F.col("c") > 0).alias("up"), F.count_if(F.col("c") < 0).alias("down"), F.round(F.avg("c"), 6).alias("mean_change"))


# W21, O3
@query("ord_top_movers", with_bars("SELECT date, ticker, k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(c) DESC, ticker) AS k FROM (SELECT date, ticker, close / lag(close) OVER " + W + " - 1 AS c FROM bars) WHERE c IS NOT NULL) WHERE k <= 3"))
def ord_top_movers(spark: SparkSession, d: str) -> DataFrame:
    c = bars(spark, d).withColumn("c", F.col("close") / lag(F.col("close")) - 1).where("c IS NOT NULL")
    return c.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("c")), "ticker"))).where("k <= 3").select("date", "ticker", "k")


# O5
@query("ord_cycle_selection", "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, count(*) OVER () AS n FROM nation) WHERE (pos - 20 + n) % n < 10")
def ord_cycle_selection(spark: SparkSession, d: str) -> DataFrame:
    pos = table(spark, d, "nation").select("n_nationkey", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return pos.where(F.pmod(F.col("pos") - 20 + F.col("n"), F.col("n")) < 10).select("n_nationkey")


# A30, DM15: merged subscriptions
@query("agg_subscriptions", "SELECT user_id, count(*) AS subscribers, bool_or(event_type = 'signup') AS train, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def agg_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("subscribers"), F.bool_or(F.col("event_type") == "signup").alias("train"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


# JSON payloads
@query("json_props", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# Prices and indicators by date
@query("join_price_indicators", with_bars(f"SELECT b.ticker, b.date, round(b.close, 6) AS close, round(i.sma, 6) AS sma FROM bars b JOIN (SELECT ticker, date, CASE WHEN count(close) OVER {roll(5)} >= 5 THEN avg(close) OVER {roll(5)} END AS sma FROM bars) i USING (ticker, date) WHERE i.sma IS NOT NULL"))
def join_price_indicators(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    i = b.select("ticker", "date", ind.sma(F.col("close"), 5).alias("sma")).where("sma IS NOT NULL")
    return rounded(b.join(i, ["ticker", "date"]), "close", "sma")


SIGNAL = [
    RET,
    f"u AS (SELECT ticker, date, close, lag(f, 1) OVER {W} AS x, ln(lead(close) OVER {W} / close) AS next_ret FROM (SELECT *, ln(close / lag(close, 5) OVER {W}) AS f FROM r))",
]
WEIGHTS = [
    *SIGNAL,
    "z AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS lo, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker DESC) AS hi FROM u WHERE x IS NOT NULL)",
    "w AS (SELECT *, CASE WHEN n < 2 * k THEN 0.0 WHEN hi <= k THEN 0.5 / k WHEN lo <= k THEN -0.5 / k ELSE 0.0 END AS weight FROM (SELECT *, greatest(floor(n * 0.1), 1) AS k FROM z))",
]
DAYS = "t AS (SELECT date, sum(weight * coalesce(next_ret, 0)) AS gross, sum(abs(weight - w0)) AS traded FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY date), 0) AS w0 FROM w) GROUP BY date)"


def signal(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("f", ind.log_return(5))
    return df.withColumns({"x": lag(F.col("f")), "next_ret": F.log(lead(F.col("close")) / F.col("close"))})


# O3, W24
@query("bt_decile_weights", with_bars("SELECT ticker, date, round(weight, 6) AS weight FROM w", *WEIGHTS))
def bt_decile_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.decile_weights(signal(spark, d), "x"), "weight")


# W49, A49, A23
@query("bt_decile_ls", with_bars("SELECT date, round(gross, 6) AS gross, round(traded, 6) AS traded, round(gross - traded * 10 / 1e4, 6) AS net, round(sum(ln(1 + gross - traded * 10 / 1e4)) OVER (ORDER BY date), 6) AS log_equity FROM t WHERE gross - traded * 10 / 1e4 > -1", *WEIGHTS, DAYS))
def bt_decile_ls(spark: SparkSession, d: str) -> DataFrame:
    df = panels.backtest(panels.decile_weights(signal(spark, d), "x"), 10.0).where("net > -1")
    return df.select("date", *[F.round(c, 6).alias(c) for c in ("gross", "traded", "net")], F.round(F.log("equity"), 6).alias("log_equity"))


# One pass over a grid of costs
@query(
    "bt_cost_sweep",
    with_bars("SELECT bps, round(avg(gross - traded * bps / 1e4), 8) AS mean_net, round(avg(gross - traded * bps / 1e4) / stddev_samp(gross - traded * bps / 1e4) * sqrt(52), 6) AS sharpe, round(avg(traded), 6) AS turnover FROM t CROSS JOIN (SELECT unnest([0, 5, 10, 20, 50]) AS bps) GROUP BY bps", *WEIGHTS, DAYS),
)
def bt_cost_sweep(spark: SparkSession, d: str) -> DataFrame:
    days = panels.backtest(panels.decile_weights(signal(spark, d), "x"), 0.0)
    grid = days.select("gross", "traded", F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 20, 50)])).alias("bps"))
    net = F.col("gross") - F.col("traded") * F.col("bps") / 1e4
    return grid.groupBy("bps").agg(F.round(F.avg(net), 8).alias("mean_net"), F.round(F.avg(net) / F.stddev_samp(net) * F.sqrt(F.lit(52.0)), 6).alias("sharpe"), F.round(F.avg("traded"), 6).alias("turnover"))


# The flagship
@query(
    "agg_rank_ic",
    with_bars(
        """SELECT date, n, round(ic, 6) AS ic FROM (SELECT date, count(*) AS n, corr(rx, ry) AS ic, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy FROM (
  SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY next_ret) + (count(*) OVER (PARTITION BY date, next_ret) - 1) / 2.0 AS ry
  FROM u WHERE x IS NOT NULL AND next_ret IS NOT NULL) GROUP BY date) WHERE n >= 5 AND sx > 1e-12 AND sy > 1e-12""",
        *SIGNAL,
    ),
)
def agg_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    df = signal(spark, d).where("x IS NOT NULL AND next_ret IS NOT NULL")
    rank = lambda c: F.rank().over(Window.partitionBy("date").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("date", c)) - 1) / 2
    df = df.withColumns({"rx": rank("x"), "ry": rank("next_ret")})
    ic = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("ic"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return ic.where("n >= 5 AND sx > 1e-12 AND sy > 1e-12").select("date", "n", F.round("ic", 6).alias("ic"))


# A10: buckets by truncated percentile rank, not ntile
@query(
    "agg_quantile_spread",
    with_bars(
        "SELECT date, round(avg(next_ret) FILTER (WHERE b = 4) - avg(next_ret) FILTER (WHERE b = 0), 6) AS spread FROM (SELECT *, least(floor(row_number() OVER (PARTITION BY date ORDER BY x, ticker) / (count(*) OVER (PARTITION BY date))::DOUBLE * 5), 4) AS b, count(*) OVER (PARTITION BY date) AS n FROM u WHERE x IS NOT NULL AND next_ret IS NOT NULL) WHERE n >= 5 GROUP BY date",
        *SIGNAL,
    ),
)
def agg_quantile_spread(spark: SparkSession, d: str) -> DataFrame:
    df = signal(spark, d).where("x IS NOT NULL AND next_ret IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    b = F.least(F.floor(F.row_number().over(Window.partitionBy("date").orderBy("x", "ticker")) / n * 5), F.lit(4))
    df = df.withColumns({"b": b, "n": n}).where("n >= 5")
    return df.groupBy("date").agg(F.round(F.avg(F.when(F.col("b") == 4, F.col("next_ret"))) - F.avg(F.when(F.col("b") == 0, F.col("next_ret"))), 6).alias("spread"))


# SP4, SP7 use the same positions; A31: composition by year
@query("agg_by_year", with_bars("SELECT year(date) AS yr, count(*) AS n, count(DISTINCT ticker) AS names, round(avg(volume), 6) AS mean_volume FROM bars GROUP BY year(date)"))
def agg_by_year(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).groupBy(F.year("date").cast("long").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("names"), F.round(F.avg("volume"), 6).alias("mean_volume"))
