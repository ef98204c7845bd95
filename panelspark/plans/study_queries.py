"""Queries of walk-forward studies, synthetic panels and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag, rolling
from ..operators import indicators as ind
from ..operators import boosting, logistic, panels, walkforward
from ..sources import files, reports, synthetic
from ..sources.tables import BARS_SQL, NEWS_SQL, SESSIONS_SQL, bars, news, sessions
from .catalog import query
from .relational_queries import sql
from .window_queries import RET, W, with_bars


def study_panel(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """Lagged returns as features, classes of the five-bar return beyond 5 % as labels; the bars, if not given, are written once for all steps of a study."""
    df = ind.with_returns(files.stored(bars(spark, d), "bars") if known is None else known)
    df = df.withColumns({"f1": lag(F.col("ret")), "f2": lag(F.col("ret"), 2), "fwd_ret": panels.forward_return(5)})
    return df.withColumn("y", panels.three_class(F.col("fwd_ret"), F.lit(0.05))).select("ticker", "date", "f1", "f2", "fwd_ret", "y").where("f1 IS NOT NULL AND f2 IS NOT NULL AND y IS NOT NULL")


def studied(spark: SparkSession, d: str, model: walkforward.FitPredict, seeds: list[int]) -> DataFrame:
    panel = study_panel(spark, d)
    folds = panels.walk_forward(panel.select("date").distinct(), 5, 0.01, 104, 26, 26)
    return walkforward.study(panel, folds, model, seeds)


# The study's panel and blocks for the oracles
PANEL = f"sp AS (SELECT * FROM (SELECT ticker, date, lag(ret) OVER {W} AS f1, lag(ret, 2) OVER {W} AS f2, ln(lead(close, 5) OVER {W} / close) AS fwd_ret FROM r) WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND fwd_ret IS NOT NULL)"
FOLDS = """sd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sp)),
sf AS (SELECT row_number() OVER (ORDER BY t) - 1 AS fold, t, n, t - 5 - emb - 26 AS val_lo FROM (SELECT n, emb, unnest(range(104 + 5 + 26 + 5 + emb, n, 26)) AS t FROM (SELECT any_value(n) AS n, ceil(any_value(n) * 0.01)::BIGINT AS emb FROM sd)))"""


# Rows of each block of each fold, purged in between
@query(
    "wf_blocks",
    with_bars(
        "SELECT fold::INT AS fold, CASE WHEN pos < val_lo - 5 THEN 'train' WHEN pos >= t THEN 'test' ELSE 'val' END AS part, count(*) AS n, min(date) AS lo, max(date) AS hi FROM sp JOIN sd USING (date), sf WHERE pos < val_lo - 5 OR (pos >= val_lo AND pos < val_lo + 26) OR (pos >= t AND pos < least(t + 26, sf.n)) GROUP BY ALL",
        RET,
        PANEL,
        FOLDS,
    ),
)
def wf_blocks(spark: SparkSession, d: str) -> DataFrame:
    panel = study_panel(spark, d)
    folds = panels.walk_forward(panel.select("date").distinct(), 5, 0.01, 104, 26, 26)
    rows = walkforward.blocks(panel, folds, "date")
    return rows.groupBy(F.col("fold").cast("int").alias("fold"), "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))


# Raw probabilities of the share model in every fold
@query(
    "wf_share_model",
    with_bars(
        """SELECT fold::INT AS fold, date, ticker, round((c2 + 1.0) / (k + 3), 6) AS raw_up, round((c2 - c0) / (k + 3.0), 6) AS raw_score, y FROM (SELECT sf.fold, a.date, a.ticker, CASE WHEN a.fwd_ret > 0.05 THEN 2 WHEN a.fwd_ret < -0.05 THEN 0 ELSE 1 END AS y, a.f1 > 0 AS up FROM sp a JOIN sd USING (date), sf WHERE pos >= t AND pos < least(t + 26, sf.n))
JOIN (SELECT sf.fold, f1 > 0 AS up, count(*) AS k, count(*) FILTER (WHERE fwd_ret > 0.05) AS c2, count(*) FILTER (WHERE fwd_ret < -0.05) AS c0 FROM sp JOIN sd USING (date), sf WHERE pos < val_lo - 5 GROUP BY ALL) USING (fold, up)""",
        RET,
        PANEL,
        FOLDS,
    ),
)
def wf_share_model(spark: SparkSession, d: str) -> DataFrame:
    out = studied(spark, d, walkforward.share_model("f1"), [0])
    return out.select("fold", "date", "ticker", F.round("raw_up", 6).alias("raw_up"), F.round(F.col("raw_up") - F.col("raw_down"), 6).alias("raw_score"), "y")


FEATURES = ["f1", "f2", "f3", "f4", "f5"]


def feature_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The study's blocks with five features: two returns, momentum, deviation and volume."""
    known = files.stored(bars(spark, d), "bars")
    df = ind.with_returns(known)
    df = df.withColumns({"f3": F.log(lag(F.col("close")) / lag(F.col("close"), 13)), "f4": rolling(F.col("ret"), 20, F.stddev_pop, 10, -1), "f5": F.log(lag(F.col("volume")) / rolling(F.col("volume"), 20, F.avg, 10, -1))})
    more = df.select("ticker", "date", "f3", "f4", "f5")
    panel = study_panel(spark, d, known)
    folds = panels.walk_forward(panel.select("date").distinct(), 5, 0.01, 104, 26, 26)
    return walkforward.blocks(panel.join(more, ["ticker", "date"]), folds, "date")


# Multinomial logistic regression of five features in every fold, on its test block; its optimum and its loss
@query("wf_logistic_metrics")
def wf_logistic_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = feature_blocks(spark, d)
    model = logistic.fit(rows.where("part = 'train'"), "fold", FEATURES, "y")
    scored = logistic.predict(rows.where("part = 'test'"), model, "fold")
    return walkforward.block_metrics(scored)


BOOST = boosting.Settings(rounds=5, depth=3, bins=16, least_rows=10)


def boosted_blocks(spark: SparkSession, d: str) -> DataFrame:
    panel = study_panel(spark, d)
    folds = panels.walk_forward(panel.select("date").distinct(), 5, 0.01, 104, 26, 26)
    return walkforward.blocks(panel, folds, "date")


# Boosted trees of every fold, on its test block
@query("wf_boosted_metrics")
def wf_boosted_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = boosted_blocks(spark, d)
    model = boosting.fit(rows.where("part = 'train'"), "fold", ["f1", "f2"], "y", settings=BOOST)
    scored = boosting.predict(rows.where("part = 'test'"), model, "fold")
    return walkforward.block_metrics(scored)


# The first split of every fold and class, from sums of gradients by bin
@query(
    "wf_boosted_splits",
    with_bars(
        """SELECT fold::INT AS fold, class, feature, cut, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY fold, class ORDER BY gain DESC, feature, bin) AS place FROM (SELECT *, pow(lg, 2) / (lh + 1) + pow(tg - lg, 2) / (th - lh + 1) - pow(tg, 2) / (th + 1) AS gain FROM (
  SELECT fold, class, feature, bin, edges[bin + 1] AS cut, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER v AS tg, sum(h) OVER v AS th, sum(n) OVER v AS tn FROM bb WINDOW v AS (PARTITION BY fold, class, feature), w AS (PARTITION BY fold, class, feature ORDER BY bin)) WHERE ln >= 10 AND tn - ln >= 10) WHERE gain > 1e-9) WHERE place = 1""",
        RET,
        PANEL,
        FOLDS,
        "bt AS (SELECT fold, f1, f2, CASE WHEN fwd_ret > 0.05 THEN 2 WHEN fwd_ret < -0.05 THEN 0 ELSE 1 END AS y FROM sp JOIN sd USING (date), sf WHERE pos < val_lo - 5)",
        "bx AS (SELECT fold, y, 0 AS feature, f1 AS x FROM bt UNION ALL SELECT fold, y, 1, f2 FROM bt)",
        f"be AS (SELECT fold, feature, list_sort(list_distinct(quantile_disc(x, {[i / 16 for i in range(1, 16)]}))) AS edges FROM bx GROUP BY ALL)",
        "bp AS (SELECT fold, class, greatest(count(*) FILTER (WHERE y = class) / count(*)::DOUBLE, 1e-9) AS p FROM bt, (SELECT unnest(range(3))::INT AS class) GROUP BY fold, class)",
        "bb AS (SELECT fold, class, feature, len(list_filter(edges, lambda e: e < x)) AS bin, any_value(edges) AS edges, sum(p - (y = class)::INT) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM bx JOIN be USING (fold, feature) JOIN bp USING (fold) GROUP BY ALL)",
    ),
)
def wf_boosted_splits(spark: SparkSession, d: str) -> DataFrame:
    model = boosting.fit(boosted_blocks(spark, d).where("part = 'train'"), "fold", ["f1", "f2"], "y", settings=boosting.Settings(rounds=1, depth=1, bins=16, least_rows=10))
    rows = [(f, k, int(t.feature[0]), float(model.edges[f][t.feature[0]][t.cut[0]]), float(t.gain[0])) for f, trees in model.trees.items() for k, t in enumerate(trees[0]) if t.feature[0] >= 0]  # a row a fold and class
    return spark.createDataFrame(rows, "fold int, class int, feature int, cut double, gain double").withColumn("gain", F.round("gain", 4))


# How far news lies before its session, and how often too near
@query(
    "agg_news_lags",
    sql("SELECT count(*) AS n, count(*) FILTER (WHERE lag < 24 - 1e-9) AS violations, round(min(lag), 6) AS lowest, round(avg(lag), 6) AS mean, round(max(lag), 6) AS highest FROM (SELECT epoch(open_ts - published_at) / 3600.0 AS lag FROM news ASOF JOIN sessions ON published_at < open_ts)", NEWS_SQL, SESSIONS_SQL),
)
def agg_news_lags(spark: SparkSession, d: str) -> DataFrame:
    found = panels.calendar_asof(news(spark, d), F.col("published_at") + F.expr("INTERVAL 1 MICROSECOND"), sessions(spark, d), "open_ts", ["open_ts"]).where("open_ts IS NOT NULL")
    hours = (F.unix_micros("open_ts") - F.unix_micros("published_at")) / 3.6e9
    lags = found.select(hours.alias("lag"))
    return lags.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lag") < 24 - 1e-9).alias("violations"), F.round(F.min("lag"), 6).alias("lowest"), F.round(F.avg("lag"), 6).alias("mean"), F.round(F.max("lag"), 6).alias("highest"))


# The aligned rows, or an error at the first one that looks ahead
@query(
    "flt_no_lookahead",
    sql("SELECT news_id, session FROM news ASOF JOIN sessions ON published_at + INTERVAL 24 HOUR <= open_ts", NEWS_SQL, SESSIONS_SQL),
)
def flt_no_lookahead(spark: SparkSession, d: str) -> DataFrame:
    found = panels.calendar_asof(news(spark, d), F.col("published_at") + F.expr("INTERVAL 24 HOURS"), sessions(spark, d), "open_ts", ["session", "open_ts"]).where("session IS NOT NULL")
    return panels.assert_no_lookahead(found, "published_at", "open_ts", 24).select("news_id", "session")


def uniform_sql(salt: str, *keys: str) -> str:
    joined = " || '-' || ".join(keys)
    return f"(('0x' || substr(md5('{salt}-' || {joined}), 1, 12))::BIGINT / 281474976710656.0)"


def normal_sql(salt: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(greatest({uniform_sql(salt + 'a', *keys)}, 1e-12))) * cos(2 * pi() * {uniform_sql(salt + 'b', *keys)}))"


GRID = f"(SELECT row_number() OVER {W} - 1 AS i, date, ticker::INT AS ticker FROM bars)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """The names and dates of the bars, for synthetic values."""
    return synthetic.grid(bars(spark, d))


# Synthetic random walks
@query(
    "src_random_walk",
    f"""WITH {BARS_SQL}, z AS (SELECT *, {normal_sql('0z', 'i', 'ticker')} AS z, {uniform_sql('0u', 'i', 'ticker')} AS u, {uniform_sql('0v', 'i', 'ticker')} AS v FROM {GRID}),
c AS (SELECT *, 100 * exp(sum(z * 0.02) OVER (PARTITION BY ticker ORDER BY i)) AS close FROM z), o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY i), 100) AS open FROM c)
SELECT date, ticker, round(open, 6) AS open, round(greatest(open, close) * (1 + u * 0.02), 6) AS high, round(least(open, close) / (1 + u * 0.02), 6) AS low, round(close, 6) AS close, floor(1e5 + 9e5 * v) AS volume FROM o""",
)
def src_random_walk(spark: SparkSession, d: str) -> DataFrame:
    rows = synthetic.random_walk(grid(spark, d))
    return rows.select("date", "ticker", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


# A common factor and noise of changing variance
@query(
    "src_factor_panel",
    f"""WITH RECURSIVE {BARS_SQL}, x AS (SELECT *, {normal_sql('0f', 'i')} * 0.008 AS f, {normal_sql('0e', 'i', 'ticker')} AS z, 0.5 + {uniform_sql('0b', 'ticker')} AS beta FROM {GRID}),
g AS (SELECT ticker, i, 2e-6 / (1 - 0.08 - 0.9) AS h FROM x WHERE i = 0 UNION ALL SELECT x.ticker, x.i, 2e-6 + 0.08 * g.h * p.z * p.z + 0.9 * g.h FROM g JOIN x ON x.ticker = g.ticker AND x.i = g.i + 1 JOIN x p ON p.ticker = g.ticker AND p.i = g.i)
SELECT date, ticker, round(beta * f + sqrt(h) * z, 8) AS ret, round(sqrt(h), 8) AS sigma, round(100 * exp(sum(beta * f + sqrt(h) * z) OVER (PARTITION BY ticker ORDER BY i)), 6) AS close FROM x JOIN g USING (ticker, i)""",
)
def src_factor_panel(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.factor_panel(grid(spark, d)).select("date", "ticker", F.round("ret", 8).alias("ret"), F.round("sigma", 8).alias("sigma"), F.round("close", 6).alias("close"))


SIGNAL = f"(SELECT date, ticker, {normal_sql('0s', 'i', 'ticker')} AS s, {normal_sql('0n', 'i', 'ticker')} AS e FROM {GRID})"


# Signals of a known strength, random ones and leaky ones
@query(
    "src_signal_panel",
    f"WITH {BARS_SQL} SELECT k AS kind, date, ticker, round(CASE WHEN k = 'leaky' THEN 0.02 * e ELSE s END, 8) AS score, round(0.02 * CASE WHEN k = 'strong' THEN 0.3 * s + sqrt(1 - 0.09) * e ELSE e END, 8) AS fwd_ret FROM {SIGNAL}, (SELECT unnest(['random', 'strong', 'leaky']) AS k)",
)
def src_signal_panel(spark: SparkSession, d: str) -> DataFrame:
    at = grid(spark, d)
    kinds = {"random": synthetic.signal_panel(at, 0.0), "strong": synthetic.signal_panel(at, 0.3), "leaky": synthetic.leaky_panel(at)}
    rows = [df.select(F.lit(k).alias("kind"), "date", "ticker", F.round("score", 8).alias("score"), F.round("fwd_ret", 8).alias("fwd_ret")) for k, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def pick_sql(words: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(w) for w in words)}][(floor({uniform_sql('0h', 'ticker', 'date')} * {len(words)}) + 1)::INT]"


# Headlines that follow returns
@query(
    "src_headlines",
    f"WITH {BARS_SQL} SELECT ticker, (date + to_minutes(floor({uniform_sql('0m', 'ticker', 'date')} * 1440)::INT))::TIMESTAMP AS published_at, 'T' || ticker || ' ' || CASE WHEN r > 0.01 THEN {pick_sql(synthetic.HEADLINES[1])} WHEN r < -0.01 THEN {pick_sql(synthetic.HEADLINES[-1])} ELSE {pick_sql(synthetic.HEADLINES[0])} END AS headline FROM (SELECT date, ticker, 0.02 * e AS r FROM {SIGNAL})",
)
def src_headlines(spark: SparkSession, d: str) -> DataFrame:
    rows = synthetic.headlines(synthetic.signal_panel(grid(spark, d), 0.0), "fwd_ret", 0.01)
    return rows.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


# A result as a LaTeX table with its provenance, written and read back
@query(
    "snk_latex_table",
    "WITH t AS (SELECT r_name, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT line FROM (SELECT 0 AS k, '\\begin{tabular}{lrr}' AS line UNION ALL SELECT 1, 'r\\_name & n & mean \\\\' UNION ALL SELECT 2, '\\midrule' UNION ALL SELECT 3, r_name || ' & ' || n || ' & ' || printf('%.2f', mean) || ' \\\\' FROM t UNION ALL SELECT 4, '\\end{tabular}' UNION ALL SELECT 5, '% source: customers by region')",
)
def snk_latex_table(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    joined = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    table = joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean"))
    path = files.scratch(spark, "latex")
    reports.write_latex(table, path, ["r_name"], {"n": 0, "mean": 2}, "customers by region")
    return spark.read.text(path).withColumnRenamed("value", "line")


# Digests of tables, whatever the order of columns and rows
@query("agg_table_digests", "SELECT 'nation' AS name, count(*) AS n, substr(md5(string_agg(md5('n_name=' || n_name || '|n_nationkey=' || n_nationkey || '|n_regionkey=' || n_regionkey), '' ORDER BY md5('n_name=' || n_name || '|n_nationkey=' || n_nationkey || '|n_regionkey=' || n_regionkey))), 1, 12) AS digest FROM nation")
def agg_table_digests(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    path = files.scratch(spark, "provenance")
    reports.write_provenance(nation, path, "nation")
    return reports.read_provenance(spark, path).select("name", "n", "digest")
