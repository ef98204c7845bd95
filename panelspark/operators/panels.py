"""Panel operators: universe, labels, splits, joins in time, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by_ticker, lag, lead, rolling


# -- cleaning ---------------------------------------------------------------

def clean_bars(df: DataFrame) -> DataFrame:
    """Drops bars with high under low or without volume, fills prices from at most 5 rows back, drops what is left null, flags moves over 50 %."""
    df = df.where((F.col("high") >= F.col("low")) & (F.col("volume") > 0))
    w = by_ticker().rowsBetween(-5, 0)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("open", "high", "low", "close")}).na.drop(subset=["open", "high", "low", "close"])
    return df.withColumn("big_move", F.coalesce(F.abs(F.col("close") / lag(F.col("close")) - 1) > 0.5, F.lit(False)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in a total order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def minimum_history(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(F.col("_n") >= n).drop("_n")


# -- joins in time ----------------------------------------------------------

def forward_asof(left: DataFrame, time: Column, right: DataFrame, right_time: str, payload: list[str], by: list[str], strict: bool = False) -> DataFrame:
    """Adds the payload of the first right row at or after ``time`` (after it, if strict); nulls past the end.

    Both sides go through one window of the union, partitioned by ``by``: no
    product, one exchange.  Right rows of a time must be unique.
    """
    fields = left.columns
    rows = left.select(F.struct(*fields).alias("_l"), *by, time.alias("_t"), F.lit(None).cast(f"struct<{','.join(f'{c}:{right.schema[c].dataType.simpleString()}' for c in payload)}>").alias("_r"), F.lit(1 if strict else 0).alias("_k"))
    marks = right.select(F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), *by, F.col(right_time).alias("_t"), F.struct(*payload).alias("_r"), F.lit(0 if strict else 1).alias("_k"))
    w = Window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(0, Window.unboundedFollowing)
    found = rows.unionByName(marks).withColumn("_f", F.first("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return found.select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in payload])


def calendar_asof(left: DataFrame, time: Column, marks: DataFrame, mark_time: str, payload: list[str]) -> DataFrame:
    """As forward_asof, for marks without a key: adds the payload of the first mark at or after ``time``.

    Each mark stands for the days since the mark before it, so the left rows find
    it by an equi-join on their day.  Only the marks, one row a session, go
    through a window without partitions; the left side has no bottleneck.
    """
    before = F.lag(mark_time).over(Window.orderBy(mark_time))
    spans = marks.select(F.col(mark_time).alias("_at"), F.struct(*payload).alias("_m")).withColumnRenamed("_at", mark_time).withColumn("_before", before)
    days = spans.where("_before IS NOT NULL").select(F.col(mark_time).alias("_at"), "_m", "_before", F.explode(F.sequence(F.to_date("_before"), F.to_date(mark_time))).alias("_day"))
    rows = left.withColumn("_t", time).withColumn("_row", F.struct(*left.columns)).select("_t", "_row", F.to_date("_t").alias("_day"))
    first = spans.where("_before IS NULL").select(F.col(mark_time).alias("_first"), F.col("_m").alias("_fm"))
    # the condition is part of the join, so rows that no mark takes stay once
    hit = (rows["_day"] == days["_day"]) & (rows["_t"] > days["_before"]) & (rows["_t"] <= days["_at"])
    joined = rows.join(days, hit, "left").select("_t", "_row", "_m").join(F.broadcast(first), F.lit(True), "left")  # one row
    mark = F.coalesce("_m", F.when(F.col("_t") <= F.col("_first"), F.col("_fm")))
    return joined.withColumn("_x", mark).select("_row.*", *[F.col(f"_x.{c}").alias(c) for c in payload])


def interval_join(news: DataFrame, dates: DataFrame, lookback_hours: int, min_lag_hours: int) -> DataFrame:
    """Headlines of a ticker in [date - lookback, date - min lag], joined on day buckets.

    Each date asks for the few days that its interval touches, so the join is an
    equi-join and the interval a filter behind it.
    """
    at = F.col("date").cast("timestamp")
    hours = lambda h: F.expr(f"INTERVAL {h} HOURS")
    days = F.sequence(F.to_date(at - hours(lookback_hours)), F.to_date(at - hours(min_lag_hours)))
    asked = dates.select("ticker", "date", F.explode(days).alias("_day"))
    had = news.withColumn("_day", F.to_date("published_at"))
    hit = (F.col("published_at") >= at - hours(lookback_hours)) & (F.col("published_at") <= at - hours(min_lag_hours))
    return asked.join(had, ["ticker", "_day"]).where(hit).drop("_day")


def membership(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ticker, session) for every session from an add up to the day before the next removal.

    A spell asks for its days, so the join with the sessions is an equi-join; an
    open spell ends after the last session.
    """
    order = Window.partitionBy("ticker").orderBy("effective_date", "prio")
    ends = sessions.agg(F.date_add(F.max("session"), 1).alias("_end"))  # one row
    spells = changes.withColumn("until", F.lead("effective_date").over(order)).where("action = 'add'").crossJoin(F.broadcast(ends))
    last = F.date_sub(F.least(F.coalesce("until", "_end"), "_end"), 1)
    days = spells.where(last >= F.col("effective_date")).select("ticker", F.explode(F.sequence("effective_date", last)).alias("session"))
    return days.join(sessions.select("session").distinct(), "session").select("ticker", "session").distinct()


def assert_no_lookahead(df: DataFrame, published: str, open_ts: str, min_lag_hours: float) -> DataFrame:
    """The rows, unless one of them was published later than ``min_lag_hours`` before its session opens: then an error names it."""
    lag = (F.unix_micros(open_ts) - F.unix_micros(published)) / 3.6e9
    told = F.raise_error(F.concat(F.lit("a row looks ahead: published "), F.col(published).cast("string"), F.lit(", session opens "), F.col(open_ts).cast("string")))
    # the check is part of a column that is returned, so that no plan leaves it out
    return df.withColumn(open_ts, F.when(lag < min_lag_hours - 1e-9, told.cast("timestamp")).otherwise(F.col(open_ts))).where(F.col(open_ts).isNotNull())


# -- labels -----------------------------------------------------------------

def forward_return(h: int) -> Column:
    return F.log(lead(F.col("close"), h) / F.col("close"))


def three_class(ret: Column, theta: Column) -> Column:
    """2 above the band, 0 below it, 1 within; null without a return or a band."""
    return F.when(ret.isNull() | theta.isNull(), None).when(ret > theta, 2).when(ret < -theta, 0).otherwise(1)


def triple_barrier(df: DataFrame, horizon: int, up: float, down: float, theta: str) -> DataFrame:
    """First barrier that the next ``horizon`` bars touch; both in one bar, or none: neutral, at that bar or the last one."""
    ahead = F.collect_list(F.struct("high", "low", "close")).over(by_ticker().rowsBetween(1, horizon))
    df = df.withColumn("_a", ahead).withColumn("_u", F.col("close") * F.exp(up * F.col(theta))).withColumn("_d", F.col("close") * F.exp(-down * F.col(theta)))
    touch = F.expr("filter(transform(_a, (x, i) -> struct(i + 1 AS i, x.high >= _u AS u, x.low <= _d AS d, x.close AS close)), x -> x.u OR x.d)")
    df = df.withColumn("_t", F.get(touch, F.lit(0)))
    last = F.get("_a", F.lit(horizon - 1))
    done = (F.size("_a") == horizon) & F.col(theta).isNotNull()
    label = F.when(F.col("_t").isNull() | (F.col("_t.u") & F.col("_t.d")), 1).when(F.col("_t.u"), 2).otherwise(0)
    return df.withColumns({"tb_label": F.when(done, label), "tb_bars": F.when(done, F.coalesce(F.col("_t.i"), F.lit(horizon))), "tb_ret": F.when(done, F.log(F.coalesce(F.col("_t.close"), last["close"]) / F.col("close")))}).drop("_a", "_u", "_d", "_t")


# -- portfolios -------------------------------------------------------------

def decile_weights(df: DataFrame, score: str, q: float = 0.1) -> DataFrame:
    """Equal long weights on the top and short ones on the bottom k = max(floor(n q), 1) names; none where n < 2 k."""
    n = F.count(F.col(score)).over(Window.partitionBy("date"))
    k = F.greatest(F.floor(n * F.lit(q)), F.lit(1))
    low = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score), "ticker"))
    high = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score).desc(), F.col("ticker").desc()))
    w = F.when(n < 2 * k, 0.0).when(high <= k, 0.5 / k).when(low <= k, -0.5 / k).otherwise(0.0)
    return df.where(F.col(score).isNotNull()).withColumn("weight", w)


def backtest(df: DataFrame, cost_bps: float) -> DataFrame:
    """(date, gross, traded, cost, net, equity) of held weights against next returns."""
    before = F.coalesce(F.lag("weight").over(by_ticker()), F.lit(0.0))
    days = df.withColumn("_d", F.abs(F.col("weight") - before)).groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("next_ret", F.lit(0.0))).alias("gross"), F.sum("_d").alias("traded"))
    days = days.withColumn("cost", F.col("traded") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    # one row a date: the running product needs one partition and has a few thousand rows
    return days.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))


def walk_forward(dates: DataFrame, horizon: int, embargo_pct: float, train: int, val: int, refit: int) -> DataFrame:
    """Folds of sorted dates: [lo, hi) positions of train, validation and test with purge and embargo."""
    n = F.count(F.lit(1))
    emb = F.ceil(n * F.lit(embargo_pct)).cast("long")
    first = F.lit(train + horizon + val + horizon) + emb
    size = dates.agg(n.alias("n"), emb.alias("emb"), first.alias("first")).where("first < n")
    folds = size.select("n", "emb", F.posexplode(F.sequence("first", F.col("n") - 1, F.lit(refit).cast("long"))).alias("fold", "test_lo"))
    return folds.select(
        "fold",
        "test_lo",
        F.least(F.col("test_lo") + refit, F.col("n")).alias("test_hi"),
        (F.col("test_lo") - horizon - F.col("emb") - val).alias("val_lo"),
        (F.col("test_lo") - horizon - F.col("emb")).alias("val_hi"),
        F.lit(0).cast("long").alias("train_lo"),
        (F.col("test_lo") - horizon - F.col("emb") - val - horizon).alias("train_hi"),
    )


def concurrency(df: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, pos, conc): labels of the key alive at each position; labels live from pos to t1.  Events, not a join of intervals."""
    events = df.where("t1 IS NOT NULL").select(key, F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("t1") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    every = df.select(key, "pos").join(steps, [key, "pos"], "left")
    alive = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return every.select(key, "pos", alive.alias("conc"))


def uniqueness(df: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, pos, uniq): the mean of 1 / concurrency over each label's life, from running sums."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = concurrency(df, key).select(key, "pos", F.sum(1.0 / F.nullif("conc", F.lit(0))).over(w).alias("s"))
    at = df.where("t1 IS NOT NULL").select(key, "pos", "t1").join(sums.select(key, F.col("pos").alias("t1"), F.col("s").alias("hi")), [key, "t1"])
    at = at.join(sums.select(key, (F.col("pos") + 1).alias("pos"), F.col("s").alias("lo")), [key, "pos"], "left")
    return at.select(key, "pos", ((F.col("hi") - F.coalesce("lo", F.lit(0.0))) / (F.col("t1") - F.col("pos") + 1)).alias("uniq"))


def liquidity_universe(df: DataFrame, window: int, min_periods: int, floor: float, top: int) -> DataFrame:
    """Each date's ``top`` names by the median dollar volume before it, among those over the price floor."""
    df = df.withColumn("_dv", lag(F.col("close") * F.col("volume"))).withColumn("_p", lag(F.col("close")))
    df = df.withColumn("adv", rolling(F.col("_dv"), window, lambda x: F.percentile(x, F.lit(0.5)), min_periods))
    ok = df.where(F.col("adv").isNotNull() & (F.col("_p") >= floor))
    return ok.withColumn("liq_rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("adv"), "ticker"))).where(F.col("liq_rank") <= top).select("date", "ticker", "adv", "liq_rank")



def dealt_to_keys(requests: DataFrame, day: str, order: list[str], keys: int, daily: int) -> DataFrame:
    """Adds ``key_index`` (1 to keys): requests in turn by the keys, ``daily`` a day each; null for those beyond.

    The turn goes on from day to day.  Only the days' counts meet in one window.
    """
    n = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    days = requests.groupBy(day).agg(F.least(F.count(F.lit(1)), F.lit(keys * daily)).alias("_given"))
    before = F.coalesce(F.sum("_given").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = requests.withColumn("_n", n).join(days.select(day, before.alias("_before")), day)
    return placed.withColumn("key_index", F.when(F.col("_n") <= keys * daily, ((F.col("_before") + F.col("_n") - 1) % keys + 1).cast("int"))).drop("_n", "_before")


def neutral_projection(rows: DataFrame, by: str, x: str, cap: float) -> DataFrame:
    """Adds ``weight``: each group's nearest weights within the cap that sum to 0, clip(x - s, -cap, cap).

    The sum falls with s in straight pieces that meet where a name leaves or reaches the
    cap, so s is found between two of these points: for each point the sum is known
    from counts and sums of the names below it, by windows in the order of points.
    """
    group = Window.partitionBy(by)
    # at x - cap a name comes down from the cap, at x + cap it reaches the other one
    points = rows.select(by, F.explode(F.array(F.struct((F.col(x) - cap).alias("s"), F.lit(1).alias("k"), F.col(x).alias("v")), F.struct((F.col(x) + cap).alias("s"), F.lit(-1).alias("k"), F.col(x).alias("v")))).alias("p")).select(by, "p.*")
    upto = group.orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    inside, total, fixed = F.sum("k").over(upto), F.sum(F.col("k") * F.col("v")).over(upto), F.sum(F.when(F.col("k") == -1, 1).otherwise(0)).over(upto)
    began = F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(upto)
    n = F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(group)
    # names between the caps give v - s, those not yet down the cap, those at the other one minus the cap
    line = points.withColumns({"_in": inside, "_v": total, "_at": (n - began - fixed) * cap}).withColumn("_sum", F.col("_v") - F.col("_in") * F.col("s") + F.col("_at"))
    # the last point whose sum is not negative; from it on the sum falls with the names between the caps
    last = line.groupBy(by).agg(F.max_by(F.struct("s", "_in", "_sum"), F.when(F.col("_sum") >= -1e-15, F.col("s"))).alias("_l"))
    shift = F.col("_l.s") + F.when(F.col("_l._in") > 0, F.col("_l._sum") / F.col("_l._in")).otherwise(0.0)
    return rows.join(last.select(by, shift.alias("_shift")), by).withColumn("weight", F.greatest(F.least(F.col(x) - F.col("_shift"), F.lit(cap)), F.lit(-cap))).drop("_shift")
