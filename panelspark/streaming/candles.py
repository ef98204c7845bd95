"""Structured Streaming: candles, counts and triggers over ticks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; event time as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def candle_columns(order: Column | None = None) -> list[Column]:
    """Open, high, low, close and the largest cumulative volume of a window's ticks; shared by batch and stream."""
    order = F.struct("ts", "event_id") if order is None else order
    return [F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.max("event_id").alias("volume")]


def tumbling_candles(stream: DataFrame, width: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("ticker")).agg(*candle_columns()).select("ticker", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def carried_open(candles: DataFrame) -> DataFrame:
    """A candle opens at the close before it; high and low take it in."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("time"))
    opened = F.coalesce(before, F.col("open"))
    return candles.withColumns({"open": opened, "high": F.greatest("high", opened), "low": F.least("low", opened)})


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finished(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end; its rows as a table in the shared folder, written by the executors.

    append: the rows of all batches; complete: those of the last one.  ``path``: a
    folder of the caller's, whose checkpoint and rows an earlier run may have left.
    """
    spark = stream.sparkSession
    again = path is not None
    path = path or files.scratch(spark, "stream")
    written: list[int] = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # a batch that is run again replaces itself
        written.append(batch)

    store = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # state machines need it; a stream keeps the settings of its start
    try:
        run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, store) if store else spark.conf.unset(STORE)
    run.awaitTermination()
    if again:
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)
    batches = sorted(set(written)) if mode == "append" else written[-1:]
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={b}" for b in batches])


def to_json_lines(stream: DataFrame, path: str, every: str | None = None) -> None:
    """Appends a stream's rows as JSON lines; each row once, whatever fails in between.  ``every``: time between batches; else what is there now."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    run = stream.writeStream.format("json").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(**trigger).start()
    if not every:
        run.awaitTermination()


def in_time(stream: DataFrame, width: int) -> DataFrame:
    """Ticks (ticker, event_id, second, value, late); late: of an older bucket of ``width`` seconds than the newest one that its key has seen before it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -(1 << 62)
        held = [[p[c].to_numpy() for c in ("event_id", "second", "value")] for p in parts]  # plain arrays; names are added to a chunk
        event, second, value = (np.concatenate(some) for some in zip(*held, strict=True))
        del held
        order = np.argsort(event, kind="stable")
        for at in range(0, len(order), 10_000):
            some = order[at : at + 10_000]
            bucket = second[some] // width
            before = np.maximum.accumulate(np.concatenate([[newest], bucket]))
            newest = int(before[-1])
            yield pd.DataFrame({"ticker": key[0], "event_id": event[some], "second": second[some], "value": value[some], "late": bucket < before[:-1]})
        state.update((newest,))

    rows = stream.select(F.col("event_type").alias("ticker"), "event_id", F.unix_seconds("ts").alias("second"), "value")
    return rows.groupBy("ticker").applyInPandasWithState(step, "ticker string, event_id long, second long, value double, late boolean", "newest long", "append", GroupStateTimeout.NoTimeout)


def carried_candles(stream: DataFrame, width: int) -> DataFrame:
    """(ticker, bucket, open, high, low, close): a candle opens at the close before it, ticks of an older bucket are dropped; a row whenever a batch changes a candle, the last one of a bucket holds."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        candle = list(state.get) if state.exists else None
        changed: dict[int, tuple] = {}
        for row in pd.concat(list(parts)).sort_values("event_id", kind="stable").itertuples():
            bucket = row.second // width
            if candle is not None and bucket < candle[0]:
                continue
            if candle is None or bucket > candle[0]:
                begin = row.value if candle is None else candle[4]
                candle = [bucket, begin, begin, begin, begin]
            candle[2:] = [max(candle[2], row.value), min(candle[3], row.value), row.value]
            changed[bucket] = tuple(candle)
        if candle is not None:
            state.update(tuple(candle))
        yield pd.DataFrame([(key[0], *c) for c in changed.values()], columns=["ticker", "bucket", "open", "high", "low", "close"])

    rows = stream.where("value IS NOT NULL").select(F.col("event_type").alias("ticker"), "event_id", F.unix_seconds("ts").alias("second"), "value")
    return rows.groupBy("ticker").applyInPandasWithState(step, "ticker string, bucket long, open double, high double, low double, close double", "bucket long, open double, high double, low double, close double", "append", GroupStateTimeout.NoTimeout)


#: Least mean and least largest move of the prices that a retraining is worth; prices looked at, and needed for a judgement.
LEAST_MEAN, LEAST_SPIKE, LAST_PRICES, ENOUGH_PRICES = 0.0015, 0.004, 40, 8


def quiet(prices: list[float]) -> bool:
    """Whether enough prices are known and none of their moves is worth a retraining."""
    known = [p for p in prices if p > 0]
    if len(known) < ENOUGH_PRICES:
        return False
    moves = []
    for a, b in zip(known, known[1:], strict=False):
        moves.append(abs(b - a) / max(abs(a), 1e-6))
        if moves[-1] >= LEAST_SPIKE:
            return False
    return sum(moves) / len(moves) < LEAST_MEAN


def retrain_triggers(stream: DataFrame, least: int = 20, cooldown: int = 300) -> DataFrame:
    """(ticker, at_tick): a trigger at ``least`` new ticks since the last one, ``cooldown`` seconds apart at least, unless the last prices are quiet."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, base, last, prices = state.get if state.exists else (0, 0, -1, [])
        prices, out = list(prices), []
        rows = pd.concat(list(parts)).sort_values(["second", "event_id"], kind="stable")
        for at, price in zip(rows["second"].tolist(), rows["price"].tolist(), strict=True):
            seen += 1
            prices = [*prices[1 - LAST_PRICES :], price]
            if seen - base >= least and (last < 0 or at - last >= cooldown) and not quiet(prices):
                out.append(seen)
                base, last = seen, at
        state.update((seen, base, last, prices))
        yield pd.DataFrame({"ticker": [key[0]] * len(out), "at_tick": out})

    rows = stream.select(F.col("event_type").alias("ticker"), "event_id", F.unix_seconds("ts").alias("second"), F.coalesce("value", F.lit(0.0)).alias("price"))
    return rows.groupBy("ticker").applyInPandasWithState(step, "ticker string, at_tick long", "seen long, base long, last long, prices array<double>", "append", GroupStateTimeout.NoTimeout)


def merged_state(stream: DataFrame, key: str, order: Column, numbers: dict[str, Column], names: dict[str, Column]) -> DataFrame:
    """The last finite value of each number and the last non-empty one of each name; what is neither leaves the state as it is."""
    finite = {n: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for n, c in numbers.items()} | {n: F.nullif(c, F.lit("")) for n, c in names.items()}
    return stream.groupBy(key).agg(*[F.max_by(c, F.when(c.isNotNull(), order)).alias(n) for n, c in finite.items()])


def latest_state(stream: DataFrame) -> DataFrame:
    """The last event of each user: an upsert of the newest values."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
