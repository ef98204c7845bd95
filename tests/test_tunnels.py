"""State machines of streams: the same log in one run and over restarts, bounded and expiring state."""

from __future__ import annotations

import shutil

import pandas as pd
from pyspark.sql import functions as F

from panelspark.streaming import candles, tunnels

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def folder(spark, tmp_path, rows, files):
    """A stream over a folder into which files come one by one."""
    path, parts = tmp_path / "in", tmp_path / "parts"
    path.mkdir()
    size = -(-len(rows) // files)
    for n in range(files):
        frame = pd.DataFrame(rows[n * size : (n + 1) * size], columns=["event_id", "ts", "user_id", "value"])
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.parquet(str(parts / str(n)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))

    def arrive(n):
        for f in (parts / str(n)).glob("*.parquet"):
            shutil.copy(f, path / f"{n}-{f.name}")

    return stream, arrive


def events(n, users=3, gap=3600):
    return [(i, pd.Timestamp(1_700_000_000 + i * gap, unit="s"), i * 7 % users, 100.0 + i * 37 % 11) for i in range(n)]


def plain_buffer(rows, size):
    held = {}
    for i, _, user, value in rows:
        held[user] = [*held.get(user, []), (i, value)][-size:]
    return sorted((u, i, v) for u, ticks in held.items() for i, v in ticks)


def test_buffers_go_on_after_restarts(spark, tmp_path):
    rows = events(60)
    stream, arrive = folder(spark, tmp_path, rows, 2)
    out = tunnels.buffered(stream, 8)
    for n in range(2):  # each run starts from the checkpoint of the one before
        arrive(n)
        found = candles.finished(out, "append", str(tmp_path / "out"))
        held = tunnels.newest(found).select("ticker", "event_id", "price").collect()
        assert sorted(tuple(r) for r in held) == plain_buffer(rows[: 30 * (n + 1)], 8)


def test_tunnel_logs_alike_in_one_run_and_over_restarts(spark, tmp_path):
    rows = events(240, users=4)
    subscriptions = spark.createDataFrame([(0, True), (1, True), (2, False), (3, True)], "ticker long, train boolean")
    schedule = tunnels.Schedule(wait=2 * 3600, cold_run=10 * 3600, later_run=5 * 3600, least_ticks=9)
    logs = []
    for files, sub in ((1, "a"), (3, "b")):
        (tmp_path / sub).mkdir()
        stream, arrive = folder(spark, tmp_path / sub, rows, files)
        for n in range(files):
            arrive(n)
            log = candles.finished(tunnels.predict_tunnel(stream, subscriptions, schedule), "append", str(tmp_path / sub / "out"))
        logs.append(sorted((r.ticker, r.place, r.second, r.status, r.reason) for r in log.collect()))
    assert logs[0] == logs[1]
    statuses = [s for t, _, _, s, _ in logs[0] if t == 1]
    assert statuses[:3] == ["training_queued", "training_started", "training_completed"] and {r[0] for r in logs[0]} == {0, 1, 3}
    reasons = [r for t, _, _, s, r in logs[0] if t == 1 and s == "training_completed"]
    assert reasons[0] == "cold_start" and set(reasons[1:]) == {"continuous_retrain"} and len(reasons) > 2
    seconds = [s for t, _, s, _, _ in logs[0] if t == 1]
    assert seconds == sorted(seconds)


def test_timers_end_a_training_without_further_ticks(spark, tmp_path):
    rows = [*events(1, 1), (1, pd.Timestamp(1_700_900_000, unit="s"), 9, 1.0)]  # user 0 never comes again
    stream, arrive = folder(spark, tmp_path, rows, 1)
    arrive(0)
    log = candles.finished(tunnels.predict_tunnel(stream, spark.createDataFrame([(0, True)], "ticker long, train boolean")), "append").orderBy("place").collect()
    assert [(r.second - 1_700_000_000, r.status) for r in log] == [(0, "training_queued"), (6 * 3600, "training_started"), (30 * 3600, "training_completed")]


def test_queue_drops_its_oldest_and_raises_priorities(spark, tmp_path):
    asked = [(1, 0), (2, 1), (1, 2), (1, 1), (3, 0), (4, 0), (None, None), (5, 1), (None, None), (None, None), (None, None), (None, None)]
    rows = [(i, pd.Timestamp(1_700_000_000 + i, unit="s"), -1 if t is None else t, float("nan") if p is None else float(p)) for i, (t, p) in enumerate(asked)]
    stream, arrive = folder(spark, tmp_path, rows, 2)
    requests = stream.select(F.lit(0).cast("long").alias("worker"), F.col("user_id").alias("ticker"), "event_id", "ts", F.when(~F.isnan("value"), F.col("value")).alias("priority"))
    for n in range(2):
        arrive(n)
        log = candles.finished(tunnels.job_queue(requests, 3), "append", str(tmp_path / "out"))
    assert [(r.event_id, r.action, r.ticker, r.priority) for r in log.orderBy("event_id", "place").collect()] == [
        (0, "queued", 1, 0), (1, "queued", 2, 1), (2, "upgraded", 1, 2), (4, "queued", 3, 0), (5, "dropped", 1, 2), (5, "queued", 4, 0),
        (6, "started", 2, 1), (7, "queued", 5, 1), (8, "started", 3, 0), (9, "started", 4, 0), (10, "started", 5, 1),
    ]


def kept_rows(spark, out, path):
    """Rows in state after a run."""
    spark.conf.set(candles.STORE, candles.ROCKS)
    try:
        run = out.writeStream.format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(candles.STORE)
    run.awaitTermination()
    return run.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_old_answers_and_limits_are_evicted(spark, tmp_path):
    """Of fifty names that came once, long ago, no state is left."""
    rows = [(i, pd.Timestamp(1_700_000_000 + i, unit="s"), i, 1.0) for i in range(50)] + [(50, pd.Timestamp(1_700_900_000, unit="s"), 99, 1.0)]
    stream, arrive = folder(spark, tmp_path, rows, 1)
    arrive(0)
    for n, out in enumerate((tunnels.cached(stream, 600), tunnels.limited(stream, 2, 600, 10))):
        assert kept_rows(spark, out, str(tmp_path / f"state{n}")) < 10


def test_rows_of_a_key_are_objects_by_chunks():
    """400,000 rows of one key in order; their objects are never in memory together."""
    import tracemalloc

    n = 400_000
    frames = (pd.DataFrame({"second": range(n - at, n - at - 10_000, -1), "event_id": range(at, at + 10_000), "ticker": 1}) for at in range(0, n, 10_000))
    tracemalloc.start()
    before, count = -1, 0
    for second, event, ticker in tunnels.in_order(frames, "ticker"):
        assert second > before and second + event == n and ticker == 1
        before, count = second, count + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 30e6
    assert list(tunnels.in_order(iter([]), "ticker")) == []
    assert [e for _, e in tunnels.in_order(iter([pd.DataFrame({"second": [2, 1, 1], "event_id": [1, 3, 2]})]), last=2)] == [3, 1]


def test_names_share_groups_and_keep_their_own_logs(spark, tmp_path, monkeypatch):
    """Sixty names in two groups, some of which come in the first file only; their timeouts come although their groups have rows."""
    rows = [(i, pd.Timestamp(1_700_000_000 + i * 600, unit="s"), i % (60 if i < 180 else 23), 100.0 + i * 37 % 11) for i in range(540)]
    subscriptions = spark.range(60).selectExpr("id AS ticker", "id % 5 > 0 AS train")
    schedule = tunnels.Schedule(wait=2 * 3600, cold_run=10 * 3600, later_run=5 * 3600, least_ticks=9)
    logs = []
    for sub, shards, files in (("a", 2, 3), ("b", 100_000, 1)):
        monkeypatch.setattr(tunnels, "SHARDS", shards, raising=False)
        (tmp_path / sub).mkdir()
        stream, arrive = folder(spark, tmp_path / sub, rows, files)
        out = tunnels.predict_tunnel(stream, subscriptions, schedule)
        for n in range(files):
            arrive(n)
            log = candles.finished(out, "append", str(tmp_path / sub / "out"))
        logs.append(sorted(tuple(str(v) for v in r) for r in log.collect()))
        if sub == "a":
            assert kept_rows(spark, out, str(tmp_path / "state")) <= 2
    assert logs[0] == logs[1] and len({r[0] for r in logs[0]}) == 48


def test_buffers_hold_ticks_without_a_name(spark, tmp_path):
    """Rows without a name are one name's, apart from those of name 0; many names share a group."""
    rows = events(90, users=40)
    stream, arrive = folder(spark, tmp_path, rows, 2)
    stream = stream.withColumn("user_id", F.when(F.col("user_id") != 5, F.col("user_id")))
    for n in range(2):
        arrive(n)
        found = candles.finished(tunnels.buffered(stream, 2), "append", str(tmp_path / "out"))
    held = tunnels.newest(found).select("ticker", "event_id", "price").collect()
    assert sorted((5 if r.ticker is None else r.ticker, r.event_id, r.price) for r in held) == plain_buffer(rows, 2)
    assert sum(r.ticker is None for r in held) == 2
