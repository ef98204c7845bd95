"""Packing of documents into sequences by the sum of squares (operator 5).

A piece goes where the sum, over all gaps, of the squared number of open
sequences with that gap becomes smallest; a full sequence no longer counts.  The
rule runs over three orders of the pieces, in one of them with a new sequence as a
choice only where no open one has room, and the packing of fewest sequences is
taken.

Pieces are dealt to shards of at most ``SHARD_PIECES``, as many of each length to one
as to the other, and each shard is packed by the rule.  The rule only looks at
lengths, so shards alike are packed alike and one plan, made from the histogram of
lengths, serves them all: a slot of the plan takes the pieces of a length that have
its place in their shards.  What does not divide by the number of shards is dealt
and packed in the same way over fewer shards, down to one.  So the driver's work and
the plan's size have a fixed bound, and every piece is placed by the rule.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .token_store import encoded

#: Pieces of a shard, at most; the shards of all levels of the plan together have less than twice as many.
SHARD_PIECES = 1 << 17


def place_all(items: np.ndarray, capacity: int, sparing: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum-of-squares packing of the items in their order: sequence and offset of each, and the number of sequences.

    sparing: a new sequence is a choice only where no open one has room.
    """
    cost = np.zeros(capacity + 1, dtype=np.int64)  # 2 * open sequences with each gap; 0 for a closed one and for none
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    blocked = np.int64(1) << 40
    barred = np.full(capacity + 1, blocked)  # blocked where no sequence has that gap; a new one is always to be had
    barred[capacity] = blocked // 2 if sparing else 0
    where, offset, n = np.empty(len(items), np.int64), np.empty(len(items), np.int64), 0
    for i, s in enumerate(items.tolist()):
        change = cost[: capacity - s + 1] - cost[s:]
        change += barred[s:]
        change[0] -= 1  # filling a sequence adds no square
        change[-1] -= 1  # nor does a new one take one away
        gap = s + int(change.argmin())
        if gap == capacity:
            seq, n = n, n + 1
        else:
            seq = stacks[gap].pop()
            cost[gap] -= 2
            if not stacks[gap]:
                barred[gap] = blocked
        where[i], offset[i] = seq, capacity - gap
        rest = gap - s
        if rest:
            stacks[rest].append(seq)
            cost[rest] += 2
            barred[rest] = 0
    return where, offset, n


def place_best(items: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The rule over three orders of the items: longest first, sparing; over half first, the rest mixed; all mixed.  The one with fewest sequences."""
    long_first = np.sort(items)[::-1]
    mixed = np.random.Generator(np.random.PCG64(len(items))).permutation(items)
    big = long_first > capacity // 2
    orders = (long_first, np.concatenate([long_first[big], mixed[mixed <= capacity // 2]]), mixed)
    tried = [(x, *place_all(x, capacity, sparing=i == 0)) for i, x in enumerate(orders)]
    return min(tried, key=lambda t: t[3])


@dataclass
class Plan:
    """Slots by length.  Slot i of a length takes the ranks from ``begin[i]`` up to the next slot's, one in each of the sequences from ``sequence[i]`` on."""

    first: np.ndarray  # first slot of each length
    begin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def make_plan(histogram: np.ndarray, capacity: int, shard_pieces: int = SHARD_PIECES) -> Plan:
    """Plan for histogram[length] pieces of each length 1..capacity."""
    left = histogram.astype(np.int64).copy()
    rows, base = [], 0
    if left[capacity]:
        rows.append((np.array([capacity]), np.array([left[capacity]]), np.array([0]), np.array([0])))
        base = int(left[capacity])
        left[capacity] = 0
    shards = max(1, -(-int(left.sum()) // shard_pieces))
    while left.any():
        times = left // shards  # pieces of each length in a shard
        if times.any():
            items = np.repeat(np.arange(capacity, 0, -1), times[:0:-1])
            items, where, offset, n = place_best(items, capacity)
            rows.append((items, np.full(len(items), shards), base + where * shards, offset))
            base += n * shards
            left -= times * shards
        shards = max(1, min(shards // 2, -(-int(left.sum()) // shard_pieces)))
    if not rows:
        rows.append(tuple(np.empty(0, np.int64) for _ in range(4)))
    size, count, sequence, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(size, kind="stable")
    size, count, sequence, offset = size[order], count[order], sequence[order], offset[order]
    total = np.cumsum(count) - count
    first = np.searchsorted(size, np.arange(capacity + 2))
    begin = total - np.append(total, 0)[first[size]] if len(size) else total
    return Plan(first, begin, sequence, offset, base)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their part (the task that cut them) and their rank among its pieces of that length."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType()))])

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, arrays in encoded(batches, tokenizer_path, end_id):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(arrays):
                n, raw = len(ids), memoryview(ids.astype("<u4").tobytes())
                at = k = 0
                while at < n:
                    size = n % capacity or capacity if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            size = np.array(length, dtype=np.int64)
            order = np.argsort(size, kind="stable")
            runs = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - runs
            rank += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank)],
                names=schema.fieldNames(),
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.  Documents over the capacity are cut, the first piece
    being the shorter one.  A null text counts as empty (its end id alone; no
    piece if there is no end id), repeated ids and rows are packed each, other
    columns are ignored, an empty table gives no rows.

    One pass over the texts; after it only short rows without text move.  The
    driver receives a histogram of ``capacity`` numbers.
    """
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, capacity, shard_pieces))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        p = plan.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            slot = np.empty(len(size), np.int64)
            for length in np.unique(size).tolist():
                at = size == length
                slot[at] = p.first[length] + np.searchsorted(p.begin[p.first[length] : p.first[length + 1]], rank[at], side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p.sequence[slot] + rank - p.begin[slot]), pa.array(p.offset[slot])], names=schema.fieldNames())

    return ranked.mapInArrow(assign, schema)
