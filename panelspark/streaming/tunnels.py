"""Keyed services over ticks as state machines: prediction, training jobs, request limits, caches, tick buffers.

Every machine works in the order of event time and logs a transition with the time at
which it was due, so its log does not hang on where batches end; an event-time timeout
carries out what falls due after a key's last tick, and clears state that no later
tick can need.  State is bounded for each key.

Keys are dealt to shards by their hash, and a shard is what Spark groups by: a group's
way to Python and back costs some milliseconds, far more than the few rows of a key.  A
batch reads and writes the state of the shards that it has rows for.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.estimators import OnlineConformal
from .candles import LAST_PRICES, quiet


#: Rows that are turned into objects, or logged, at a time.
CHUNK = 10_000


#: Groups that keys are dealt to; the state of a shard is in memory at once, some 130 keys of half a million.  A stream goes on from a checkpoint with the number that it began with.
SHARDS = 4096


def in_order(frames: Iterator[pd.DataFrame], *columns: str, last: int | None = None, key: str | None = None) -> Iterator[tuple]:
    """Rows (second, event_id, columns) of one batch in the order of time, or the last ones of them; with ``key``: (key, second, event_id, columns) by key, or the last ones of each.

    Of many rows, plain arrays of these columns are in memory and objects of a chunk of
    rows only.
    """
    first = () if key is None else (key,)
    names = (*first, "second", "event_id", *columns)
    parts = [[f[c].to_numpy() for c in names] for f in frames if len(f)]
    if not parts:
        return
    held = [np.concatenate(some) if len(some) > 1 else some[0] for some in zip(*parts, strict=True)]
    del parts
    order = np.lexsort(held[1 + len(first) :: -1])
    if last is not None:
        begins = np.flatnonzero(np.diff(held[0][order])) + 1 if first else np.zeros(0, np.int64)
        ends = np.append(begins, len(order))
        order = order[np.arange(len(order)) >= np.repeat(ends, np.diff(ends, prepend=0)) - last]
    for at in range(0, len(order), CHUNK):
        some = order[at : at + CHUNK]
        yield from zip(*(column[some].tolist() for column in held), strict=True)


def logged(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


#: Rows of a log on their way, and what a key's state is after them: None if it goes.
Log = Generator[tuple, None, tuple | None]


class Machine:
    """A state machine a key: the schemas of its state and log, the columns that it reads beside second and event_id, of how many last rows of a batch (None: of all).

    Other fields are settings, or hold while a step runs.
    """

    STATE: str
    LOG: str
    COLUMNS: tuple[str, ...] = ()
    TAIL: int | None = None

    def step(self, key: int | None, rows: Iterator[tuple], state: tuple | None) -> Log:
        """A key's rows (key, second, event_id, columns) of one batch."""
        raise NotImplementedError

    def wakes(self, state: tuple) -> int | None:
        """The second by which something is to be done without rows."""
        return None

    def expire(self, key: int | None, state: tuple, second: int) -> Log:
        """What has fallen due by a second; here the state goes."""
        yield from ()
        return None

    def shard(self, group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The machines of a shard's keys, over their rows in one batch and what the watermark finds due."""
        held = {r[0]: tuple(r[1:]) for r in state.get[0]} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        log: list[tuple] = []
        for row in self.all_steps(held, () if state.hasTimedOut else parts, bool(group[1]), watermark // 1000):
            log.append(row)
            if len(log) >= CHUNK:
                yield logged(log, self.LOG)
                log = []
        if held:
            state.update(([(key, *known) for key, known in held.items()],))
        elif state.exists:
            state.remove()
        due = min((d for d in map(self.wakes, held.values()) if d is not None), default=None)
        if due is not None:
            state.setTimeoutTimestamp(max(due * 1000 - 1, watermark, 1))  # a timeout comes once the watermark has passed it
        yield logged(log, self.LOG)

    def all_steps(self, held: dict[int | None, tuple], parts: Iterator[pd.DataFrame], no_key: bool, second: int) -> Iterator[tuple]:
        def kept(key: int | None, log: Log) -> Iterator[tuple]:
            known = yield from log
            if known is None:
                held.pop(key, None)
            else:
                held[key] = known

        for name, rows in groupby(in_order(parts, *self.COLUMNS, last=self.TAIL, key="key"), itemgetter(0)):
            key = None if no_key else name
            yield from kept(key, self.step(key, rows, held.get(key)))
        for key, known in [*held.items()]:
            due = self.wakes(known)
            if due is not None and due <= second:
                yield from kept(key, self.expire(key, known, second))


def keyed(stream: DataFrame, machine: Machine, key: str, apart: bool = False) -> DataFrame:
    """Rows (key, event_id, second, ts, ...) of a stream with a watermark through a state machine a key; rows older than the watermark are left out.

    apart: a group a key, for few keys of many rows.
    """
    known = F.coalesce(key, F.lit(0)).cast("long")
    shard = known if apart else F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("long")
    rows = stream.select(shard.alias("shard"), F.col(key).isNull().alias("nameless"), known.alias("key"), "second", "event_id", *machine.COLUMNS, "ts")
    return rows.groupBy("shard", "nameless").applyInPandasWithState(machine.shard, machine.LOG, f"names array<struct<name long, {machine.STATE}>>", "append", GroupStateTimeout.EventTimeTimeout)


def timed(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).withColumn("second", F.unix_seconds("ts"))


# -- predictions --------------------------------------------------------------

@dataclass
class Schedule:
    """Training of a name: seconds that a job waits and runs, epochs and period, at first and later; ticks and seconds between trainings."""

    wait: int = 6 * 3600
    cold_run: int = 24 * 3600
    later_run: int = 4 * 3600
    cold_epochs: int = 12
    later_epochs: int = 4
    cold_period: str = "5y"
    later_period: str = "2y"
    least_ticks: int = 20
    cooldown: int = 300


TUNNEL_LOG = "ticker long, second long, place long, status string, reason string, epochs int, period string"
IDLE, QUEUED, ACTIVE = 0, 1, 2


class PredictTunnel(Machine):
    """A name's way through training and prediction, a log row for each transition and each tick's answer.

    Untrained names are queued at their first tick (cold_start).  Trained ones are
    queued again after enough ticks and time unless their prices are quiet
    (continuous_retrain), and answer a tick with prediction, training_queued or
    training_in_progress.  A retraining that is due while one waits or runs only sets
    the time of the last trigger.
    """

    STATE = "trained boolean, stage int, due long, cold boolean, base long, last long, seen long, place long, prices array<double>"
    LOG = TUNNEL_LOG
    COLUMNS = ("price",)

    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def load(self, state: tuple | None) -> None:
        start = (False, IDLE, 0, False, 0, 0, 0, 0, [])
        self.trained, self.stage, self.due, self.cold, self.base, self.last, self.seen, self.place, self.prices = state or start
        self.log: list[tuple] = []

    def saved(self) -> tuple:
        return self.trained, self.stage, self.due, self.cold, self.base, self.last, self.seen, self.place, self.prices

    def say(self, second: int, status: str, with_job: bool = False) -> None:
        s = self.schedule
        job = (("cold_start", s.cold_epochs, s.cold_period) if self.cold else ("continuous_retrain", s.later_epochs, s.later_period)) if with_job else (None, None, None)
        self.place += 1
        self.log.append((second, self.place, status, *job))

    def advance(self, second: int) -> None:
        """What has fallen due by a second."""
        if self.stage == QUEUED and self.due <= second:
            self.say(self.due, "training_started", True)
            self.stage, self.due = ACTIVE, self.due + (self.schedule.cold_run if self.cold else self.schedule.later_run)
        if self.stage == ACTIVE and self.due <= second:
            self.say(self.due, "training_completed", True)
            self.trained, self.stage, self.base, self.last = True, IDLE, self.seen, self.due

    def queue(self, second: int, cold: bool) -> None:
        if self.stage == IDLE:
            self.stage, self.due, self.cold = QUEUED, second + self.schedule.wait, cold
            self.say(second, "training_queued", True)

    def step(self, key, rows, state):
        self.load(state)
        s = self.schedule
        for _, second, _, price in rows:
            self.advance(second)
            self.seen += 1
            self.prices = [*self.prices[1 - LAST_PRICES :], price]
            if not self.trained:
                self.queue(second, True)
            else:
                if self.seen - self.base >= s.least_ticks and second - self.last >= s.cooldown and not quiet(self.prices):
                    self.last = second
                    self.queue(second, False)
                self.say(second, ("prediction", "training_queued", "training_in_progress")[self.stage])
            yield from self.told(key)
        return self.saved()

    def wakes(self, state):
        return state[2] if state[1] else None

    def expire(self, key, state, second):
        self.load(state)
        self.advance(second)
        yield from self.told(key)
        return self.saved()

    def told(self, key: int | None) -> list[tuple]:
        rows, self.log = [(key, *r) for r in self.log], []
        return rows


def predict_tunnel(ticks: DataFrame, subscriptions: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """TUNNEL_LOG rows of the names whose subscription (ticker, train) enables training."""
    rows = timed(ticks).select("ts", F.col("user_id").alias("ticker"), "event_id", "second", F.coalesce("value", F.lit(0.0)).alias("price"))
    enabled = subscriptions.where("train").select("ticker")
    return keyed(rows.join(enabled, "ticker").select("ticker", "event_id", "second", "price", "ts"), PredictTunnel(schedule or Schedule()), "ticker")


# -- training jobs --------------------------------------------------------------

QUEUE_LOG = "worker long, event_id long, place long, action string, ticker long, priority int"


class JobQueue(Machine):
    """A worker's queue of jobs, one a name, first come first served.

    A job whose name waits already raises that one's priority if its own is higher, and
    goes otherwise; where the queue is full, its oldest job is dropped.  A row without
    priority takes the oldest job.
    """

    STATE = "names array<long>, priorities array<int>"
    LOG = QUEUE_LOG
    COLUMNS = ("ticker", "priority")

    def __init__(self, limit: int):
        self.limit = limit

    def step(self, key, rows, state):
        jobs = dict(zip(*state, strict=True)) if state else {}  # in their order
        for _, _, event, ticker, priority in rows:
            said: list[tuple] = []
            if priority is None or priority != priority:
                if jobs:
                    first = next(iter(jobs))
                    said.append(("started", first, jobs.pop(first)))
            elif ticker in jobs:
                if priority > jobs[ticker]:
                    jobs[ticker] = int(priority)
                    said.append(("upgraded", ticker, jobs[ticker]))
            else:
                if len(jobs) >= self.limit:
                    first = next(iter(jobs))
                    said.append(("dropped", first, jobs.pop(first)))
                jobs[ticker] = int(priority)
                said.append(("queued", ticker, jobs[ticker]))
            yield from ((key, event, n, *s) for n, s in enumerate(said))
        return (list(jobs), list(jobs.values())) if jobs else None


def job_queue(requests: DataFrame, limit: int = 4000) -> DataFrame:
    """QUEUE_LOG rows of requests (worker, ticker, event_id, ts, priority)."""
    rows = timed(requests).select("worker", "event_id", "second", "ticker", F.col("priority").cast("double").alias("priority"), "ts")
    return keyed(rows, JobQueue(limit), "worker", apart=True)


# -- requests ---------------------------------------------------------------------

LIMIT_LOG = "key long, event_id long, allowed boolean, wait long"


class RequestLimit(Machine):
    """Whether a request is one of ``most`` in a sliding window, and how long it waits where requests keep a gap.

    The window counts allowed requests only.  A key's state goes when the window and the
    gap after its last request are over.
    """

    STATE = "allowed array<long>, start long, over long"
    LOG = LIMIT_LOG

    def __init__(self, most: int, window: int, gap: int):
        self.most, self.window, self.gap = most, window, gap

    def step(self, key, rows, state):
        seconds, start, _ = state or ([], None, None)
        for _, second, event in rows:
            seconds = [s for s in seconds if s > second - self.window]
            fits = len(seconds) < self.most
            seconds += [second] if fits else []
            start = second if start is None else max(second, start + self.gap)
            yield key, event, fits, start - second
        return seconds, start, max(second + self.window, start + self.gap)

    def wakes(self, state):
        return state[2]


def limited(ticks: DataFrame, most: int, window: int, gap: int) -> DataFrame:
    """LIMIT_LOG rows of requests by user."""
    rows = timed(ticks).select(F.col("user_id").alias("key"), "event_id", "second", "ts")
    return keyed(rows, RequestLimit(most, window, gap), "key")


CACHE_LOG = "key long, event_id long, hit boolean"


class ExpiringCache(Machine):
    """Whether a request finds its key's answer no older than ``ttl`` seconds; otherwise it is fetched anew.  Old answers are evicted by a timeout."""

    STATE = "since long"
    LOG = CACHE_LOG

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, key, rows, state):
        since = state[0] if state else None
        for _, second, event in rows:
            hit = since is not None and second - since <= self.ttl
            since = since if hit else second
            yield key, event, hit
        return (since,)

    def wakes(self, state):
        return state[0] + self.ttl + 1


def cached(ticks: DataFrame, ttl: int) -> DataFrame:
    """CACHE_LOG rows of requests by user."""
    rows = timed(ticks).select(F.col("user_id").alias("key"), "event_id", "second", "ts")
    return keyed(rows, ExpiringCache(ttl), "key")


# -- coverage ---------------------------------------------------------------------

COVERAGE_LOG = "key long, event_id long, covered boolean, level double"


class Coverage(Machine):
    """Online conformal sets of a key's scores; state: the level and the running counts of the scores' cells."""

    STATE = "level double, seen long, counts array<long>"
    LOG = COVERAGE_LOG
    COLUMNS = ("score",)

    def __init__(self, **settings: float):
        self.settings = settings

    def step(self, key, rows, state):
        level, seen, counts = state or (None, 0, None)
        machine = OnlineConformal(**self.settings, level=level, seen=seen, counts=counts)
        for _, _, event, score in rows:
            found = machine.step(score)
            if found is not None:
                yield key, event, bool(found[0]), float(found[1])
        return float(machine.level), int(machine.seen), machine.counts.tree


def conformal(scores: DataFrame, alpha: float = 0.1, gamma: float = 0.01, warm: int = 30, width: float = 1e-3, cells: int = 1 << 12) -> DataFrame:
    """COVERAGE_LOG rows of scores (key, event_id, ts, score), nulls left out."""
    rows = timed(scores.where("score IS NOT NULL")).select("key", "event_id", "second", "score", "ts")
    return keyed(rows, Coverage(alpha=alpha, gamma=gamma, warm=warm, width=width, cells=cells), "key")


# -- leases ----------------------------------------------------------------------

LEASE_LOG = "lock long, event_id long, worker long, action string"


class Lease(Machine):
    """A lock that its holder keeps for ``ttl`` seconds from its last call; it is taken when free or run out, and may be given back."""

    STATE = "worker long, until long"
    LOG = LEASE_LOG
    COLUMNS = ("worker", "leaves")

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, key, rows, state):
        holder, until = state or (None, 0)
        for _, second, event, worker, leaves in rows:
            action = None
            if holder == worker and second < until:
                action = "released" if leaves else "renewed"
            elif (holder is None or second >= until) and not leaves:
                action = "acquired"
            if action is not None:
                holder, until = (None, until) if action == "released" else (worker, second + self.ttl)
                yield key, event, worker, action
        return None if holder is None else (holder, until)


def leases(calls: DataFrame, ttl: int) -> DataFrame:
    """LEASE_LOG rows of calls (lock, worker, event_id, ts, leaves)."""
    rows = timed(calls).select("lock", "event_id", "second", "worker", "leaves", "ts")
    return keyed(rows, Lease(ttl), "lock", apart=True)


# -- buffers ------------------------------------------------------------------------

BUFFER_ROWS = "ticker long, version long, event_id long, price double"


class TickBuffer(Machine):
    """The last ``size`` ticks of a name; all of them again, under a new version, whenever a batch brings some."""

    STATE = "events array<long>, prices array<double>, version long"
    LOG = BUFFER_ROWS

    COLUMNS = ("price",)

    def __init__(self, size: int):
        self.size = self.TAIL = size

    def step(self, key, rows, state):
        events, prices, version = state or ([], [], 0)
        held = [*zip(events, prices, strict=True), *((event, price) for _, _, event, price in rows)][-self.size :]
        yield from ((key, version + 1, *tick) for tick in held)
        return [event for event, _ in held], [price for _, price in held], version + 1


def buffered(ticks: DataFrame, size: int = 2000) -> DataFrame:
    """BUFFER_ROWS of each name; the rows of its largest version are what it holds."""
    rows = timed(ticks).select(F.col("user_id").alias("ticker"), "event_id", "second", F.coalesce("value", F.lit(0.0)).alias("price"), "ts")
    return keyed(rows, TickBuffer(size), "ticker")


def newest(rows: DataFrame) -> DataFrame:
    """The rows of each name's largest version."""
    last = rows.groupBy(F.col("ticker").alias("name")).agg(F.max("version").alias("last"))
    return rows.join(last, rows["ticker"].eqNullSafe(last["name"]) & (rows["version"] == last["last"])).drop("name", "last")
