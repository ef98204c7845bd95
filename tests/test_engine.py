from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelspark.functions import finance, recursive, text
from panelspark.functions.rolling import cross_sectional_rank
from panelspark.sources import files
from panelspark.operators import metrics, panels
from panelspark.plans import catalog
from panelspark.schema import require_columns
from panelspark.streaming import candles

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names
    assert set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["win_rsi_ta", "join_asof_session", "bt_cost_sweep", "agg_ece", "txt_vocabulary", "lbl_triple_barrier", "st_sessions"])
def test_against_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine = catalog.QUERIES[name](spark, SMALL).toPandas()
    theirs = con.execute(catalog.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs)

    def rows(df):
        plain = lambda v: "-" if pd.isna(v) else round(float(v), 4) + 0.0 if isinstance(v, (int, float, np.number)) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)
        return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(mine) == rows(theirs)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        require_columns(spark.range(1), "id", "volume")


def test_smoothing_follows_pandas(spark):
    """Nulls anywhere, spans and blocks of any size, a null key, a weight of 1."""
    rng = np.random.default_rng(2)
    series = {0: [None, 1.0, 2.0, None, None, 5.0, 4.0], 1: list(rng.normal(size=700)), None: [3.0], 2: [None] * 5, 3: [x if rng.random() > 0.3 else None for x in rng.normal(size=60)]}
    rows = [(t, i, None if x is None else float(x)) for t, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticker int, date int, x double").repartition(5)
    wanted = {"u": ("x", "unseeded", 0.3, 0), "v": ("x", "unseeded", 2 / 21, 6), "w": ("x", "unseeded", 1.0, 0), "s": ("x", "seeded", 0.5, 4), "fast": ("x", "seeded", 0.9, 2)}
    for block in (None, F.floor(F.col("date") / 7), F.lit(0)):
        plan = recursive.smooth(df, wanted, block=block)
        assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
        found = {(r.ticker, r.date): r for r in plan.collect()}
        assert len(found) == len(rows)
        for t, xs in series.items():
            x = pd.Series(xs, dtype=float)
            mean = {"u": x.ewm(alpha=0.3, adjust=False).mean(), "v": x.ewm(alpha=2 / 21, adjust=False, min_periods=6).mean(), "w": x.ffill()}
            for out, n, alpha in (("s", 4, 0.5), ("fast", 2, 0.9)):
                y, first = np.full(len(x), np.nan), x.first_valid_index()
                if first is not None and len(x) >= first + n:
                    y[first + n - 1] = x[first : first + n].to_numpy().mean()
                    for i in range(first + n, len(x)):
                        y[i] = y[i - 1] + alpha * (x[i] - y[i - 1])
                mean[out] = y
            for out, y in mean.items():
                got = [found[t, i][out] for i in range(len(xs))]
                assert np.allclose(np.array(got, float), np.array(y, float), rtol=1e-11, atol=1e-12, equal_nan=True), (t, out)


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 5.0, None])] + [(2, 0, 1.0)], "date int, ticker int, x double")
    found = {(r.date, r.ticker): r.k for r in cross_sectional_rank(df, "x", "k").collect()}
    assert found[1, 0] == pytest.approx(0.1 - 0.5) and found[1, 1] == found[1, 2] == pytest.approx(0.4 - 0.5)
    assert found[1, 5] is None and found[2, 0] is None


def test_session_open_follows_daylight_saving(spark):
    days = spark.createDataFrame([("2022-03-11",), ("2022-03-14",)], "d string").select(F.to_date("d").alias("session"))
    at = F.to_utc_timestamp(F.col("session").cast("timestamp") + F.expr("INTERVAL '9:30' HOUR TO MINUTE"), "America/New_York")
    assert [str(r[0]) for r in days.orderBy("session").select(F.date_format(at, "HH:mm")).collect()] == ["14:30", "13:30"]


def test_as_of_takes_equal_times_unless_strict(spark):
    left = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00"), (3, "2024-01-05 00:00:00")], "i int, t string").select("i", F.to_timestamp("t").alias("t"), F.lit(0).alias("k"))
    right = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 00:00:00")], "name string, t string").select("name", F.to_timestamp("t").alias("at"), F.lit(0).alias("k"))
    loose = {r.i: r.name for r in panels.forward_asof(left, F.col("t"), right, "at", ["name"], ["k"]).collect()}
    strict = {r.i: r.name for r in panels.forward_asof(left, F.col("t"), right, "at", ["name"], ["k"], strict=True).collect()}
    assert loose == {1: "a", 2: "b", 3: None} and strict == {1: "b", 2: "b", 3: None}
    early = left.unionByName(spark.createDataFrame([(4, "2019-05-05 00:00:00")], "i int, t string").select("i", F.to_timestamp("t").alias("t"), F.lit(0).alias("k")))
    by_day = {r.i: r.name for r in panels.calendar_asof(early, F.col("t"), right.drop("k"), "at", ["name"]).collect()}
    assert by_day == {1: "a", 2: "b", 3: None, 4: "a"}


def test_barriers(spark):
    rows = [(0, d, 100.0, h, lo, c) for d, (h, lo, c) in enumerate([(100, 100, 100), (105, 99, 104), (120, 80, 100), (101, 99, 100), (101, 99, 100)])]
    df = spark.createDataFrame([(a, b, float(h), float(lo), float(c)) for a, b, _, h, lo, c in rows], "ticker int, date int, high double, low double, close double").withColumn("theta", F.lit(math.log(1.04)))
    found = {r.date: (r.tb_label, r.tb_bars) for r in panels.triple_barrier(df, 2, 1.0, 1.0, "theta").collect()}
    assert found[0] == (2, 1)  # the next high touches the upper barrier first
    assert found[1] == (1, 1)  # both in one bar
    assert found[3] == (None, None)  # not enough bars ahead


def test_no_index_member_on_the_day_of_removal(spark):
    changes = spark.createDataFrame([("x", "2024-01-01", "add", 1), ("x", "2024-01-03", "remove", 0)], "ticker string, d string, action string, prio int").select("ticker", F.to_date("d").alias("effective_date"), "action", "prio")
    days = spark.sql("SELECT explode(sequence(DATE'2023-12-31', DATE'2024-01-04')) AS session")
    assert sorted(str(r.session) for r in panels.membership(changes, days).collect()) == ["2024-01-01", "2024-01-02"]


def test_decile_weights_need_enough_names(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)] + [(2, 0, 1.0)], "date int, ticker int, s double")
    w = {(r.date, r.ticker): r.weight for r in panels.decile_weights(df, "s").collect()}
    assert w[1, 19] == w[1, 18] == 0.25 and w[1, 0] == -0.25 and w[1, 5] == 0 and w[2, 0] == 0


def test_newey_west_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=60)
    row = metrics.newey_west(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "date int, x double"), "x", "date", 3).first()
    d = x - x.mean()
    want = d @ d / 60 + 2 * sum((1 - k / 4) * (d[k:] @ d[:-k]) / 60 for k in range(1, 4))
    assert row.lrv == pytest.approx(want) and row.t_stat == pytest.approx(x.mean() / math.sqrt(want / 60))


def test_kelly_and_softmax(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.02, 0.04)], "mu double, s2 double")
    rows = df.select(finance.fractional_kelly(F.col("mu"), F.col("s2"), 0.5, 0.3).alias("k"), *[x.alias(f"p{i}") for i, x in enumerate(finance.softmax([F.col("mu"), F.col("s2")]))]).collect()
    assert [r.k for r in rows] == [0.3, 0.25] and all(r.p0 + r.p1 == pytest.approx(1) for r in rows)


def test_clean_text(spark):
    df = spark.createDataFrame([("<script>x<y</script><b>Apple</b> &amp; $TSLA rose 5% to $1.2 billion, see www.a.com or me@b.org 1234567",)], "t string")
    assert df.select(text.clean(F.col("t"))).first()[0] == "<TICKER_AAPL> & <TICKER_TSLA> rose <PERCENT> to <MONEY> , see <URL> or <EMAIL> <BIGNUM>"


def prints_of(rng) -> list[int]:
    """Fingerprints around a few centres, some equal."""
    out = []
    for _ in range(12):
        base = int(rng.integers(0, 2**62))
        out += [base, base] + [base ^ sum(1 << int(b) for b in rng.choice(62, size=k, replace=False)) for k in (1, 1, 2, 2, 3, 3, 4, 5)]
    return [out[i] for i in rng.permutation(len(out))]


def test_near_fingerprints_are_complete(spark):
    prints = list(dict.fromkeys(prints_of(np.random.default_rng(3))))
    df = spark.createDataFrame(list(enumerate(prints)), "n int, p long")
    found = {(r.a, r.b) for r in text.near_fingerprints(df, "p").collect()}
    assert found == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 3}


def test_greedy_removal_keeps_the_first(spark):
    prints, kept = prints_of(np.random.default_rng(4)), []
    for i, p in enumerate(prints):
        if all(bin(p ^ prints[k]).count("1") > 3 for k in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(prints)), "n int, p long")
    found = text.keep_first(df, "n", "p", files.stored)
    assert sorted(r.n for r in found.where("kept").collect()) == kept and found.count() == len(prints)


def test_greedy_removal_broadcasts_no_rows_and_reads_open_pairs_only(spark):
    """A chain of prints, each near the next: rounds read fewer and fewer pairs, and no join broadcasts."""
    prints = [0]
    for i in range(40):
        prints.append(prints[-1] ^ (3 << (i * 2 % 62)))
    df = spark.createDataFrame(list(enumerate(prints)), "n int, p long")
    plans, sizes = [], []

    def store(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        out = files.stored(rows)
        sizes.append((out.columns, out.count()))
        return out

    kept = []
    for i, p in enumerate(prints):
        if all(bin((p ^ prints[k]) % 2**64).count("1") > 3 for k in kept):
            kept.append(i)
    found = text.keep_first(df, "n", "p", store)
    assert sorted(r.n for r in found.where("kept").collect()) == kept
    assert not any("Broadcast" in p for p in plans[1:]) and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = [n for columns, n in sizes if columns == ["a", "b"]]
    assert len(pairs) > 5 and pairs == sorted(pairs, reverse=True) and pairs[-1] == 0


def test_simhash_takes_a_batch_in_parts():
    """Of 800,000 distinct words in one batch, the hashes of a part are in memory at once."""
    import tracemalloc

    import pyarrow as pa

    rows = [[f"w{i}-{k}" for k in range(200)] for i in range(4000)] + [None, []]
    words = pa.array(rows, pa.list_(pa.string()))
    tracemalloc.start()
    whole = text.simhash.func(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(whole) == 4002 and whole[-1].as_py() == whole[-2].as_py() == 0
    assert whole[3999] == text.simhash.func(words.slice(3999, 1))[0]


def test_cleaning_in_order(spark):
    rows = [("<p>Apple&nbsp;Inc &amp;lt; caf\u00e9 a@b.co www.x.y</p><script>x</script>",), ("Visa Inc \u20ac5 $1.2 million 3.5% 1234567",)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.clean(F.col("t"))).collect()]
    assert found == ["<TICKER_AAPL> < cafe <EMAIL> <URL>", "<TICKER_V> \u20ac5 <MONEY> <PERCENT> <BIGNUM>"]


def test_names_are_looked_for_where_they_stand(spark):
    rows = ["no name here", "APPLE inc, pineapple, the S&P 500", "$AAPL apple", None, "", "visa inc www.a.b $3 million x@y.z", "alpha beta"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    names = text.ENTITIES | {"alpha": "A", "<ticker_a> beta": "AB"}  # the last one stands there only once the first is replaced
    plan = df.select("i", text.mark_entities(F.col("t"), names).alias("m"))
    found = [r.m for r in plan.orderBy("i").collect()]
    assert found[:5] == ["no name here", "<TICKER_AAPL>, pineapple, the <TICKER_SPX>", "<TICKER_AAPL> <TICKER_AAPL>", None, ""]
    short = df.select("i", text.mark_entities(F.col("t"), {"alpha beta": "A", "<ticker_a>": "B"}).alias("m")).orderBy("i").collect()
    assert short[6].m == "<TICKER_A>"  # as before: no word boundary beside a bracket
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 5


def test_look_ahead_raises(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS published_at, TIMESTAMP'2024-01-02 09:30:00' AS open_ts")
    assert panels.assert_no_lookahead(df, "published_at", "open_ts", 24).count() == 1
    with pytest.raises(Exception, match="looks ahead"):
        panels.assert_no_lookahead(df, "published_at", "open_ts", 48).collect()


def test_simhash_votes(spark):
    def fnv1a(word):
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    def print_of(words):
        votes = [sum(1 if fnv1a(w) >> i & 1 else -1 for w in words) for i in range(64)]
        return sum(1 << i for i in range(64) if votes[i] > 0)

    rows = [["a", "b", "b", "c"], [], ["één", "", "a" * 300, "b"], None, ["x"]]
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>").coalesce(1).select("i", text.simhash("t").alias("p")).orderBy("i").collect()
    assert [r.p % 2**64 for r in found] == [print_of(r or []) for r in rows]


def test_candles_open_at_the_close_before(spark):
    df = spark.createDataFrame([("x", 1, 10.0, 12.0, 9.0, 11.0), ("x", 2, 13.0, 14.0, 12.0, 13.0)], "ticker string, time int, open double, high double, low double, close double")
    second = candles.carried_open(df).where("time = 2").first()
    assert (second.open, second.high, second.low) == (11.0, 14.0, 11.0)


def test_settings():
    from panelspark import config

    c = config.load('{"horizon": 3, "seeds": [4]}')
    assert c.horizon == 3 and c.seeds == (4,) and c.digest() == config.load('{"seeds": [4], "horizon": 3}').digest() != config.StudyConfig().digest()
    for wrong in ('{"horizon": 0}', '{"alpha": 1}', '{"speed": 1}', '{"seeds": []}'):
        with pytest.raises(ValueError):
            config.load(wrong)


def test_quiet_prices_suppress_a_trigger():
    from panelspark.streaming import candles

    assert candles.quiet([100.0] * 8) and not candles.quiet([100.0] * 7)
    assert not candles.quiet([100.0] * 7 + [101.0]) and not candles.quiet([100 * 1.002**i for i in range(10)])
