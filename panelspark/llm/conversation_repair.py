"""Repair of the structure of conversations by least cost (operator 12).

A conversation should read as an optional system turn and then pairs of a user
and an assistant turn.  Edits: keep a turn (free), give it the role user or
assistant (2), delete it (3, a must for blank and repeated ones), insert an empty
turn of user or assistant (2); a cut-off turn that stays costs 1.

Faults are marked by DataFrame functions.  The dynamic program runs over time in
arrays: the runs of turns in a batch are dealt into buckets of similar length, and
the costs of the four states (nothing, system, user, assistant last) of all
conversations in a bucket are updated together, turn by turn.  It goes backward
first and stores, for each turn, which edit is due in each state; then forward,
where the edits are traced for all conversations of a bucket together.

Both ways are streams over turns sorted within partitions of whole conversations,
after one shuffle.  At a batch's end only the open conversation's four costs, or
its state and running digest, are carried on, so a conversation of any length
needs no more memory than its own audit string; since a digest is sequential, one
conversation is read by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that may be inserted, or given its role, in each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Cost of ending in each state: a system or user turn needs the rest of a pair.
END = np.array([0, 2 * INSERT, INSERT, 0])
NEVER = 1 << 40
LETTERS = "DIKR"
D, I, K, R = range(4)
#: Kinds of turns: by initial s, u, a or other, 4 more if cut off; then those that must go, and rows that take no part.
MUST_GO, ABSENT = 8, 9
KEEP_COST = np.full((10, 4), NEVER)
KEEP_STATE = np.zeros((10, 4), np.int64)
REROLE_COST = np.full((10, 4), NEVER)
DELETE_COST = np.full(10, DELETE)
DELETE_COST[ABSENT] = 0
for cut_off in (0, 1):
    for initial, froms, to in ((0, (START,), SYSTEM), (1, (START, SYSTEM, ASSISTANT), USER), (2, (USER,), ASSISTANT)):
        for state in froms:
            KEEP_COST[initial + 4 * cut_off, state] = KEEP + cut_off
            KEEP_STATE[initial + 4 * cut_off, state] = to
    REROLE_COST[4 * cut_off : 4 * cut_off + 4] = REROLE + cut_off


def columns_of(conv: str, turn: str, role: str, text: str) -> list[Column]:
    return [F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")]


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present) of a table of turns; null roles and texts are one space."""
    return df.select(*columns_of(conv, turn, role, text), F.lit(True).alias("present"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """As ``turns_of``, with faults by the checksum of ``conv:turn`` modulo 20.

    0 drops a row (it is not present), 1 empties its text, 2 takes away its full
    stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    rows = df.select(*columns_of(conv, turn, role, text))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select("conv", "turn", "role", "text", (F.col("kind") != 0).alias("present"))


def marked(turns: DataFrame) -> DataFrame:
    """Turns with their first fault: 1 blank, 2 said before in the same role, 3 cut off; whole conversations in a partition."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    # the window needs no shuffle of its own; row_number keeps no rows
    before = F.row_number().over(Window.partitionBy("conv", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("present"), 0).when(said == "", 1).when(before, 2).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(~F.col("present"), ABSENT).when(F.col("fault").isin(1, 2), MUST_GO)
    kind = kind.otherwise(F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("fault") == 3, 4).otherwise(0))
    return turns.repartition("conv").withColumn("fault", fault.cast("byte")).withColumn("kind", kind.cast("byte"))


def runs_of(column: pa.Array) -> tuple[np.ndarray, list]:
    """First rows of the runs of one conversation, and the conversations."""
    names = column.to_pylist()
    first = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])] if names else []
    return np.array(first, np.int64), [names[i] for i in first]


def buckets(starts: np.ndarray, n: int):
    """Yield (runs, rows): runs of lengths up to the same power of two, and the rows by time, -1 past a run's end."""
    length = np.diff(np.append(starts, n))
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for s in np.unique(size):
        runs = np.flatnonzero(size == s)
        time = np.arange(int(length[runs].max()))[:, None]
        yield runs, np.where(time < length[runs], starts[runs] + time, -1)


def backward(kind: np.ndarray, starts: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits due at each row, two bits a state, and the costs before each run; rows run back in time, ``after``: costs [run, state] behind them."""
    plan = np.zeros(len(kind), np.uint8)
    before = after.copy()
    kinds = np.append(kind, ABSENT)
    for runs, rows in buckets(starts, len(kind)):
        cost = after[runs]
        for row in rows:
            of = kinds[row]
            delete = DELETE_COST[of][:, None] + cost
            keep = KEEP_COST[of] + np.take_along_axis(cost, KEEP_STATE[of], 1)
            rerole = REROLE_COST[of] + cost[:, NEXT]
            taken = np.minimum(np.minimum(delete, keep), rerole)
            best = np.minimum(taken, np.minimum(INSERT + taken[:, NEXT], 2 * INSERT + taken[:, NEXT[NEXT]]))
            # of equal costs the least letter
            edit = np.where(delete == best, D, np.where(INSERT + best[:, NEXT] == best, I, np.where(keep == best, K, R)))
            inside = row >= 0
            plan[row[inside]] = (edit << (2 * np.arange(4))).sum(axis=1)[inside]
            cost = best
        before[runs] = cost
    return plan, before


def forward(plan: np.ndarray, kind: np.ndarray, starts: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(states before, insertions before, edit) of each row and the state after each run."""
    n = len(plan)
    entered, inserted, edits = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.full(n + 1, D)
    plans, kinds = np.append(plan, 0).astype(np.int64), np.append(kind, ABSENT)
    state = state.copy()
    for runs, rows in buckets(starts, n):
        now = state[runs]
        for row in rows:
            present = kinds[row] != ABSENT
            entered[row] = now
            edit = (plans[row] >> (2 * now)) & 3
            for _ in range(2):
                more = present & (edit == I)
                inserted[row] += more
                now = np.where(more, NEXT[now], now)
                edit = (plans[row] >> (2 * now)) & 3
            edits[row] = edit
            now = np.where(present & (edit == K), KEEP_STATE[kinds[row], now], np.where(present & (edit == R), NEXT[now], now))
        state[runs] = now
    return entered[:n], inserted[:n], edits[:n], state


def planned(turns: DataFrame) -> DataFrame:
    """Marked turns with the edits due, sorted by conversation and time within partitions."""
    rows = marked(turns)
    late = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    early = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    schema = T.StructType([*rows.schema.fields, T.StructField("plan", T.ShortType())])
    place = rows.columns.index("kind")

    def run(batches):
        last, costs = None, END
        for batch in batches:
            starts, names = runs_of(batch.column(0))
            if not names:
                continue
            after = np.tile(END, (len(names), 1))
            if last is not None and names[0] == last[0]:
                after[0] = costs
            kind = batch.column(place).to_numpy().astype(np.int64)
            plan, before = backward(kind, starts, after)
            last, costs = (names[-1],), before[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plan.astype(np.int16))], names=schema.fieldNames())

    return rows.sortWithinPartitions("conv", *late).mapInArrow(run, schema).sortWithinPartitions("conv", *early)


class Open:
    """What is known of a conversation whose turns are being read."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.illegal, self.counts = conv, START, 0, 0, [0, 0, 0, 0]
        self.audit: list[str] = []
        self.low = self.high = self.turn = None
        self.distinct = 0
        self.initial: str | None = None
        self.hash, self.lines = hashlib.sha256(), 0

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self, state: int) -> int:
        self.audit.append("I")
        self.cost += INSERT
        state = int(NEXT[state])
        self.say(ROLES[state], "")
        return state

    def see(self, turn: int | None, role: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.turn
            self.turn = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def close(self) -> tuple:
        for _ in range(int(END[self.state]) // INSERT):
            self.state = self.insert(self.state)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def traced(batch: pa.RecordBatch, state: np.ndarray, starts: np.ndarray) -> tuple:
    kind, plan = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("kind", "plan"))
    return kind, *forward(plan.astype(np.uint8), kind, starts, state)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame) -> DataFrame:
    """A row a conversation: faults, the cheapest edits and a digest of the repaired turns.

    ``turns``: (conv, turn, role, text, present) of ``turns_of`` or ``damaged``; rows
    that are not present only name their conversation.  Returns conv, gaps (turn
    numbers missing between the least and the greatest), blank, duplicate, truncated,
    illegal (neighbours whose roles may not follow each other), cost, audit (the
    edits' initials, Delete, Insert, Keep, Rerole; of equally cheap ones the least
    string) and repaired_sha256 (of ``role:text``, joined by line feeds).  Turns are
    ordered by number, nulls first, then by role and text.  Null ids are one
    conversation.  An empty table gives no rows.
    """
    schema = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in REPORT), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def rows_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in done], t) for i, t in enumerate([kind, *[pa.int64()] * 6, pa.string(), pa.string()])]
        return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    def run(batches):
        now, kind_of = None, None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            starts, names = runs_of(batch.column(0))
            if not names:
                continue
            going_on = now is not None and names[0] == now.conv
            state = np.full(len(names), START)
            if going_on:
                state[0] = now.state
            kind, entered, inserted, edits, after = (x.tolist() for x in traced(batch, state, starts))
            turn, role, text, fault = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("turn", "role", "text", "fault"))
            done = []
            for k, (low, high) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True)):
                if k or not going_on:
                    done += [now.close()] if now is not None else []
                    now = Open(names[k])
                for i in range(low, high):
                    if kind[i] == ABSENT:
                        continue
                    now.see(turn[i], role[i], fault[i])
                    at = entered[i]
                    for _ in range(inserted[i]):
                        at = now.insert(at)
                    now.audit.append(LETTERS[edits[i]])
                    if edits[i] == D:
                        now.cost += DELETE
                    else:
                        now.cost += (fault[i] == 3) + (REROLE if edits[i] == R else KEEP)
                        now.say(role[i] if edits[i] == K else ROLES[int(NEXT[at])], text[i])
                now.state = after[k]
            if done:
                yield rows_of(done, kind_of)
        if now is not None:
            yield rows_of([now.close()], kind_of)

    return planned(turns).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): the repaired conversations; place counts from 0, inserted turns have no number."""
    schema = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        last, place, state_now, kind_of = None, 0, START, None

        def closing() -> list[tuple]:
            out, at = [], state_now
            for k in range(int(END[state_now]) // INSERT):
                at = int(NEXT[at])
                out.append((last[0], place + k, "I", None, ROLES[at], ""))
            return out

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=schema.fieldNames())

        for batch in batches:
            kind_of = batch.schema.field(0).type
            starts, names = runs_of(batch.column(0))
            if not names:
                continue
            going_on = last is not None and names[0] == last[0]
            state = np.full(len(names), START)
            if going_on:
                state[0] = state_now
            kind, entered, inserted, edits, after = (x.tolist() for x in traced(batch, state, starts))
            turn, role, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("turn", "role", "text"))
            rows = []
            for k, (low, high) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True)):
                if k or not going_on:
                    rows += closing() if last is not None else []
                    last, place = (names[k],), 0
                for i in range(low, high):
                    if kind[i] == ABSENT:
                        continue
                    at = entered[i]
                    for _ in range(inserted[i]):
                        at = int(NEXT[at])
                        rows.append((names[k], place, "I", None, ROLES[at], ""))
                        place += 1
                    if edits[i] != D:
                        rows.append((names[k], place, LETTERS[edits[i]], turn[i], role[i] if edits[i] == K else ROLES[int(NEXT[at])], text[i]))
                        place += 1
                state_now = after[k]
            yield rows_of(rows)
        if last is not None:
            yield rows_of(closing())

    return planned(turns).mapInArrow(run, schema)
