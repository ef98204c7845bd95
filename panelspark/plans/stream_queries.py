"""Queries of streams, each run to the end of its input; the oracle is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import events, table
from ..streaming import candles, tunnels
from .catalog import query

CANDLES = "c AS (SELECT event_type AS ticker, time_bucket(INTERVAL 6 HOUR, ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, max(event_id) AS volume FROM events GROUP BY ALL)"


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# ST1, D6, S26
@query("st_ohlc_tumbling", f"WITH {CANDLES} SELECT * FROM c")
def st_ohlc_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return plain_time(candles.finished(candles.tumbling_candles(candles.ticks(spark, d), "6 hours", "1 hour"), "complete"), "time")


# ST1: the open carried over, in batch
@query(
    "st_candle_carry",
    f"WITH {CANDLES} SELECT ticker, time, o AS open, greatest(high, o) AS high, least(low, o) AS low, close, volume FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY time), open) AS o FROM c)",
)
def st_candle_carry(spark: SparkSession, d: str) -> DataFrame:
    batch = events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), F.col("event_type").alias("ticker")).agg(*candles.candle_columns()).select("ticker", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")
    return plain_time(candles.carried_open(batch), "time")


# Sliding windows
@query("st_sliding", "SELECT s AS time, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    stream = candles.ticks(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return plain_time(candles.finished(stream.select(F.col("w.start").alias("time"), "event_type", "n"), "complete"), "time")


# Session windows
@query(
    "st_sessions",
    "SELECT user_id, min(ts) AS time, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
)
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream = candles.ticks(spark, d).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return plain_time(candles.finished(stream.select("user_id", F.col("w.start").alias("time"), "n"), "complete"), "time")


# Duplicates within the watermark
@query("st_dedup", "SELECT DISTINCT event_id FROM events")
def st_dedup(spark: SparkSession, d: str) -> DataFrame:
    return candles.finished(candles.ticks(spark, d).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


# ST3: the last ticks of a name, a ring in state
@query("st_last_ticks", "SELECT user_id AS ticker, event_id, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50")
def st_last_ticks(spark: SparkSession, d: str) -> DataFrame:
    rows = candles.finished(tunnels.buffered(candles.ticks(spark, d), 50), "append")
    return tunnels.newest(rows).select("ticker", "event_id", "price")


SCHEDULE = tunnels.Schedule()
QUIET = f"len(p) >= {candles.ENOUGH_PRICES} AND list_avg(list_transform(range(2, len(p) + 1), lambda i: abs(p[i] - p[i - 1]) / greatest(abs(p[i - 1]), 1e-6))) < {candles.LEAST_MEAN} AND list_max(list_transform(range(2, len(p) + 1), lambda i: abs(p[i] - p[i - 1]) / greatest(abs(p[i - 1]), 1e-6))) < {candles.LEAST_SPIKE}"
JOB = f"CASE WHEN cold THEN {{'reason': 'cold_start', 'epochs': {SCHEDULE.cold_epochs}, 'period': '{SCHEDULE.cold_period}'}} ELSE {{'reason': 'continuous_retrain', 'epochs': {SCHEDULE.later_epochs}, 'period': '{SCHEDULE.later_period}'}} END"
NO_JOB = "{'reason': NULL::VARCHAR, 'epochs': NULL::INT, 'period': NULL::VARCHAR}"


def said(second: str, status: str, job: str, when: str) -> str:
    return f"CASE WHEN {when} THEN [{{'second': {second}, 'status': {status}, 'job': {job}}}] ELSE [] END"


#: What falls due by ``second``, first the start and then the end of a training; base: ticks seen before.
ADVANCED = f"""SELECT * REPLACE (trained OR e AS trained, CASE WHEN e THEN 0 ELSE stage END AS stage, CASE WHEN e THEN seen ELSE base END AS base, CASE WHEN e THEN due ELSE last END AS last), log || {said("due", "'training_completed'", JOB, "e")} AS said
FROM (SELECT *, stage = 2 AND due <= second AS e FROM (SELECT * REPLACE (CASE WHEN b THEN 2 ELSE stage END AS stage, CASE WHEN b THEN due + CASE WHEN cold THEN {SCHEDULE.cold_run} ELSE {SCHEDULE.later_run} END ELSE due END AS due), {said("due", "'training_started'", JOB, "b")} AS log FROM (SELECT *, stage = 1 AND due <= second AS b FROM [FROM])))"""


# ST5, ST6, ST8, ST18: names on their way through training and prediction
@query(
    "st_predict_tunnel",
    f"""WITH RECURSIVE q AS (SELECT user_id AS ticker, floor(epoch(ts))::BIGINT AS second, row_number() OVER w AS pos, list_filter(list(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {candles.LAST_PRICES - 1} PRECEDING AND CURRENT ROW), lambda x: x > 0) AS p
  FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT ticker, second, pos, coalesce({QUIET}, false) AS quiet FROM q),
s AS (SELECT DISTINCT ticker, 0::BIGINT AS pos, false AS trained, 0 AS stage, 0::BIGINT AS due, false AS cold, 0::BIGINT AS base, 0::BIGINT AS last, []::STRUCT(second BIGINT, status VARCHAR, job STRUCT(reason VARCHAR, epochs INT, period VARCHAR))[] AS said FROM t
UNION ALL
SELECT ticker, pos, trained, stage, due, cold, base, last,
  said || {said("second", "'training_queued'", JOB, "fresh")} || {said("second", "CASE stage WHEN 0 THEN 'prediction' WHEN 1 THEN 'training_queued' ELSE 'training_in_progress' END", NO_JOB, "trained")}
FROM (SELECT * REPLACE (CASE WHEN fresh THEN 1 ELSE stage END AS stage, CASE WHEN fresh THEN second + {SCHEDULE.wait} ELSE due END AS due, CASE WHEN fresh THEN NOT trained ELSE cold END AS cold, CASE WHEN again THEN second ELSE last END AS last)
FROM (SELECT *, stage = 0 AND (again OR NOT trained) AS fresh FROM (SELECT *, trained AND pos - base >= {SCHEDULE.least_ticks} AND second - last >= {SCHEDULE.cooldown} AND NOT quiet AS again FROM ({ADVANCED.replace('[FROM]', "(SELECT s.ticker, t.pos, s.trained, s.stage, s.due, s.cold, s.base, s.last, t.second, t.quiet, s.pos AS seen FROM s JOIN t ON t.ticker = s.ticker AND t.pos = s.pos + 1)")}))))),
f AS ({ADVANCED.replace('[FROM]', "(SELECT s.ticker, s.pos, s.trained, s.stage, s.due, s.cold, s.base, s.last, n.second, s.pos AS seen FROM s JOIN (SELECT ticker, max(pos) AS pos FROM t GROUP BY ticker) USING (ticker, pos), (SELECT floor(epoch(max(ts)))::BIGINT - 3600 AS second FROM events) n)")})
SELECT ticker, x.second AS second, x.status AS status, x.job.reason AS reason, x.job.epochs AS epochs, x.job.period AS period FROM (SELECT ticker, unnest(said) AS x FROM s WHERE pos > 0 UNION ALL SELECT ticker, unnest(said) FROM f)""",
)
def st_predict_tunnel(spark: SparkSession, d: str) -> DataFrame:
    subscriptions = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_acctbal") > 0).alias("train"))
    log = candles.finished(tunnels.predict_tunnel(candles.ticks(spark, d), subscriptions, SCHEDULE), "append")
    return log.select("ticker", "second", "status", "reason", "epochs", "period")


QUEUE_LIMIT = 20
REQUESTS = f"r AS (SELECT user_id % 4 AS worker, event_id, user_id AS ticker, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 1 WHEN 'error' THEN NULL ELSE 0 END AS p, row_number() OVER (PARTITION BY user_id % 4 ORDER BY floor(epoch(ts)), event_id) AS pos FROM events)"


# ST7, ST8: jobs queued, raised in priority, dropped and taken, by worker
@query(
    "st_job_queue",
    f"""WITH RECURSIVE {REQUESTS},
s AS (SELECT DISTINCT worker, 0::BIGINT AS pos, []::STRUCT(t BIGINT, p INT)[] AS q, []::STRUCT(action VARCHAR, ticker BIGINT, priority INT)[] AS log, 0::BIGINT AS event_id FROM r
UNION ALL
SELECT worker, pos, CASE WHEN p IS NULL THEN q[2:] WHEN ix > 0 THEN CASE WHEN up THEN q[:ix - 1] || [{{'t': ticker, 'p': p}}] || q[ix + 1:] ELSE q END ELSE CASE WHEN full_ THEN q[2:] ELSE q END || [{{'t': ticker, 'p': p}}] END,
  CASE WHEN p IS NULL THEN CASE WHEN len(q) > 0 THEN [{{'action': 'started', 'ticker': q[1].t, 'priority': q[1].p}}] ELSE [] END
    WHEN ix > 0 THEN CASE WHEN up THEN [{{'action': 'upgraded', 'ticker': ticker, 'priority': p}}] ELSE [] END
    ELSE CASE WHEN full_ THEN [{{'action': 'dropped', 'ticker': q[1].t, 'priority': q[1].p}}] ELSE [] END || [{{'action': 'queued', 'ticker': ticker, 'priority': p}}] END, event_id
FROM (SELECT *, ix > 0 AND p > q[ix].p AS up, len(q) >= {QUEUE_LIMIT} AS full_ FROM (SELECT s.worker, r.pos, s.q, r.event_id, r.ticker, r.p, coalesce(list_position(list_transform(s.q, lambda x: x.t), r.ticker), 0) AS ix FROM s JOIN r ON r.worker = s.worker AND r.pos = s.pos + 1)))
SELECT worker, event_id, x.action AS action, x.ticker AS ticker, x.priority AS priority FROM (SELECT worker, event_id, unnest(log) AS x FROM s WHERE pos > 0)""",
)
def st_job_queue(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") != "error", 0)
    requests = candles.ticks(spark, d).select((F.col("user_id") % 4).alias("worker"), F.col("user_id").alias("ticker"), "event_id", "ts", priority.alias("priority"))
    return candles.finished(tunnels.job_queue(requests, QUEUE_LIMIT), "append").select("worker", "event_id", "action", "ticker", "priority")


MOST, WINDOW, GAP = 3, 2 * 86400, 12 * 3600


# ST15: requests within a sliding window, and the wait that a gap between requests makes
@query(
    "st_rate_limit",
    f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS pos FROM events),
s AS (SELECT DISTINCT key, 0::BIGINT AS pos, 0::BIGINT AS event_id, []::BIGINT[] AS q, false AS allowed, NULL::BIGINT AS start, 0::BIGINT AS wait FROM r
UNION ALL
SELECT key, pos, event_id, CASE WHEN len(q) < {MOST} THEN q || [t] ELSE q END, len(q) < {MOST}, go, go - t FROM (SELECT s.key, r.pos, r.event_id, r.t, list_filter(s.q, lambda x: x > r.t - {WINDOW}) AS q, greatest(r.t, coalesce(s.start + {GAP}, r.t)) AS go FROM s JOIN r ON r.key = s.key AND r.pos = s.pos + 1))
SELECT key, event_id, allowed, wait FROM s WHERE pos > 0""",
)
def st_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return candles.finished(tunnels.limited(candles.ticks(spark, d), MOST, WINDOW, GAP), "append")


# ST6, ST18: state across batches
@query(
    "st_retrain_triggers",
    f"""WITH RECURSIVE q AS (SELECT event_type AS ticker, floor(epoch(ts))::BIGINT AS second, row_number() OVER w AS pos, list_filter(list(coalesce(value, 0)) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id ROWS BETWEEN {candles.LAST_PRICES - 1} PRECEDING AND CURRENT ROW), lambda x: x > 0) AS p
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id)),
t AS MATERIALIZED (SELECT ticker, second, pos, coalesce({QUIET}, false) AS quiet FROM q),
s AS (SELECT DISTINCT ticker, 0::BIGINT AS pos, 0::BIGINT AS base, NULL::BIGINT AS last, false AS fires FROM t
UNION ALL
SELECT ticker, pos, CASE WHEN fires THEN pos ELSE base END, CASE WHEN fires THEN second ELSE last END, fires FROM (SELECT s.ticker, t.pos, s.base, s.last, t.second, t.pos - s.base >= 20 AND (s.last IS NULL OR t.second - s.last >= 300) AND NOT t.quiet AS fires FROM s JOIN t ON t.ticker = s.ticker AND t.pos = s.pos + 1))
SELECT ticker, pos AS at_tick FROM s WHERE fires""",
)
def st_retrain_triggers(spark: SparkSession, d: str) -> DataFrame:
    return candles.finished(candles.retrain_triggers(candles.ticks(spark, d)), "append")


# ST2: late ticks by the newest bucket in state
@query(
    "st_late_rule",
    "SELECT event_type AS ticker, count(*) AS n, count(*) FILTER (WHERE b < newest) AS late FROM (SELECT event_type, floor(epoch(ts))::BIGINT // 3600 AS b, max(floor(epoch(ts))::BIGINT // 3600) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events) GROUP BY event_type",
)
def st_late_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = candles.finished(candles.in_time(candles.ticks(spark, d), 3600), "append")
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


# ST1, ST2: candles in state, the open carried over, late ticks dropped
@query(
    "st_carried_candles",
    """WITH t AS (SELECT event_type AS ticker, event_id, value, floor(epoch(ts))::BIGINT // 3600 AS b FROM events), k AS (SELECT * FROM (SELECT *, max(b) OVER (PARTITION BY ticker ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM t) WHERE newest IS NULL OR b >= newest),
c AS (SELECT ticker, b, arg_min(value, event_id) AS first, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM k GROUP BY ALL)
SELECT ticker, b AS bucket, o AS open, greatest(high, o) AS high, least(low, o) AS low, close FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY b), first) AS o FROM c)""",
)
def st_carried_candles(spark: SparkSession, d: str) -> DataFrame:
    return candles.finished(candles.carried_candles(candles.ticks(spark, d), 3600), "append")


# ST15: requests that a cache answers
@query(
    "st_cache_hits",
    """WITH RECURSIVE q AS (SELECT user_id AS key, event_id, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS pos FROM events),
c AS (SELECT key, event_id, pos, s AS since, false AS hit FROM q WHERE pos = 1 UNION ALL SELECT q.key, q.event_id, q.pos, CASE WHEN q.s - c.since <= 86400 THEN c.since ELSE q.s END, q.s - c.since <= 86400 FROM c JOIN q ON q.key = c.key AND q.pos = c.pos + 1) SELECT key, event_id, hit FROM c""",
)
def st_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return candles.finished(tunnels.cached(candles.ticks(spark, d), 86400), "append")


# A stream's rows as JSON lines, read back
@query("st_json_sink", "SELECT event_id, user_id, event_type, value FROM events")
def st_json_sink(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "json-lines")
    candles.to_json_lines(candles.ticks(spark, d).select("event_id", "user_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").json(path)


# ST16: values that are not finite, and empty names, leave the state as it is
@query(
    "st_merged_state",
    "SELECT user_id, arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS v, arg_max(state, (ts, event_id)) FILTER (WHERE state <> '') AS state FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS state FROM events) GROUP BY user_id",
)
def st_merged_state(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    name = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("event_type"))
    return candles.finished(candles.merged_state(candles.ticks(spark, d), "user_id", F.struct("ts", "event_id"), {"v": value}, {"state": name}), "complete")


# ST11
@query("st_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at, count(*) AS n FROM events GROUP BY user_id")
def st_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return plain_time(candles.finished(candles.latest_state(candles.ticks(spark, d)), "complete"), "at")
