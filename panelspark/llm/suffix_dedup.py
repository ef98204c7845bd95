"""Deletion of byte strings that occur elsewhere, by merge-sorted suffixes (operator 13).

A window is a string of ``length`` bytes.  A byte goes if a window over it also
starts anywhere else.  Sorting the suffixes at all places would move every byte
``length`` times; a sparse suffix array is enough.

Sampled suffixes.  A window is told by the place in its first three fifths whose gram
has the least hash, the first of equal ones: so which place it is follows from the
window's own bytes, and windows after another share theirs.  Equal windows have it the
same o bytes after their starts; they are equal if o bytes before and length - o bytes
after their places agree.

Distinguishing prefixes.  A suffix whose first ``depth`` bytes occur once decides
its windows: none occurs elsewhere.  Suffixes are counted by a hash of these bytes
first, and only those that may have a partner go on (a bitmap of bounded size says
which; the counts after it are exact).  Suffixes that agree in all bytes of all
their windows are one context with a count.  A prefix with one context needs no
sorting: its windows repeat if the context does.

Merge sort.  The other contexts are sorted where they are read, and front-coded
(common bytes with the one before, then the rest) when runs are exchanged.  A loser
tree merges the runs of a bucket; it holds the known common prefix of every head
with the last winner, so a longer known prefix wins without looking at any byte
and comparisons begin behind the known one.  Neighbours' common prefixes, of the
suffixes and of the reversed bytes before them, then tell for each o which windows
are equal.  Contexts of a prefix that has more than ``hot`` of them would crowd one
bucket: their windows are counted one by one over all tasks instead.

Windows found are joined with their documents as intervals; texts are read four
times and shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, hash_spans, mix, ragged, text_chunks
from .shared import written

LENGTH, GRAM = 400, 8
#: Contexts of one prefix that a bucket may get together, and contexts of a bucket, about.
HOT, BUCKET = 50_000, 16_384
#: Bits of a bitmap, at most (16 MB).
MAX_BITS = 27
#: Bytes of a longer text that are cut at a time, and contexts of a sorted run.
SEGMENT, RUN = 1 << 20, 1 << 14
MULTIPLIER, RADIX = U64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


class Shape:
    """The sizes that follow from the length of a window."""

    def __init__(self, length: int):
        #: Largest o; windows too short for a gram are told by their start.
        self.length, self.top = length, max(0, min(length * 3 // 5, length - GRAM))
        #: Bytes that every window has behind its sampled place.
        self.depth = length - self.top


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        _POWERS[base] = out
    return _POWERS[base][:n]


class Slice:
    """A megabyte of texts, cut into pieces [begin, end) (texts or segments of them), and its suffixes.

    ``x``: places, ``low`` and ``high``: first and last start of the windows that belong to each.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, shape: Shape):
        self.data, self.shape = data, shape
        n, last = len(data), end - shape.length
        number = np.maximum(last - begin + 1, 0)
        start, piece = ragged(begin, number), np.repeat(np.arange(len(begin)), number)
        place = start
        if shape.top and len(start):
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            hashes = np.ndarray(n, dtype="<u8", buffer=padded.data, strides=(1,)) * MULTIPLIER
            # least (hash, place) of the top + 1 places from each one on
            least, width = (hashes >> U64(32) << U64(32)) | np.arange(n, dtype=np.uint64), 1
            while 2 * width <= shape.top + 1:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            rest = shape.top + 1 - width
            least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            place = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        self.x, self.low, self.piece = place[first], start[first], piece[first]
        self.high = start[np.append(first[1:], len(start)) - 1] if len(first) else start
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * powers(RADIX, n), out=self.sums[1:])
        self.back = powers(pow(RADIX, -1, 1 << 64), n + 1)

    def hashed(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def prefixes(self) -> np.ndarray:
        """A hash of the first ``depth`` bytes of each suffix."""
        return self.hashed(self.x, self.x + self.shape.depth)

    def contexts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(least o, greatest o, two hashes of all bytes of their windows) of some suffixes."""
        x, low, high = self.x[some], self.low[some], self.high[some]
        stop = high + self.shape.length
        return x - high, x - low, hash_spans(self.data, low, stop), self.hashed(low, stop)


def slices(column: pa.Array, shape: Shape):
    """Yield (Slice, row of each piece, offset of each piece in its text, begin of each piece)."""
    for row, data, offsets in text_chunks(column):
        if len(offsets) > 2 or len(data) <= SEGMENT:
            n = len(offsets) - 1
            yield Slice(data, offsets[:-1].copy(), offsets[1:], shape), row + np.arange(n), np.zeros(n, np.int64), offsets[:-1]
            continue
        for at in range(0, len(data), SEGMENT):  # a long text; a window belongs to the segment that it starts in
            part = data[at : at + SEGMENT + shape.length - 1]
            yield Slice(part, np.zeros(1, np.int64), np.array([len(part)]), shape), np.array([row]), np.array([at]), np.zeros(1, np.int64)


def key_of(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the first bits of the hashes in a table, set where one has them; at most 2**MAX_BITS bits."""
    bits = min(MAX_BITS, max(15, int(hashes.count()).bit_length() + 4))
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = hashes.groupBy(F.shiftright(place, 15).alias("page")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).collect()  # 16 MB at most
    field = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        field[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return field


def has_bit(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U64(64 - (int(len(field)).bit_length() + 2))
    return (field[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def prefix_counts(texts: DataFrame, shape: Shape) -> DataFrame:
    """(prefix) that several suffixes have."""

    def run(batches):
        for batch in batches:
            for cut, *_ in slices(batch.column(0), shape):
                yield pa.RecordBatch.from_arrays([pa.array(cut.prefixes().view(np.int64))], names=["prefix"])

    counted = texts.select("text").mapInArrow(run, "prefix long").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.where("n > 1").select("prefix"), "prefixes")


CONTEXT = ["near", "far", "one", "two"]


def candidates(texts: DataFrame, field: np.ndarray, shape: Shape) -> DataFrame:
    """(prefix, near, far, one, two, key, place, n): suffixes whose prefix may occur elsewhere; n: texts with that key."""
    sent = texts.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for cut, row, base, begin in slices(batch.column(1), shape):
                prefix = cut.prefixes()
                some = np.flatnonzero(has_bit(sent.value, prefix))
                near, far, one, two = cut.contexts(some)
                piece = cut.piece[some]
                keys = batch.column(0).take(pa.array(row[piece]))
                place = cut.x[some] - begin[piece] + base[piece]
                arrays = [pa.array(prefix[some].view(np.int64)), pa.array(near, pa.int32()), pa.array(far, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), keys, pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["prefix", *CONTEXT, "key", "place"])

    rows = texts.select("key", "text").mapInArrow(run, "prefix long, near int, far int, one long, two long, key binary, place long")
    return written(rows.groupBy("prefix", *CONTEXT, "key", "place").agg(F.count(F.lit(1)).alias("n")), "suffixes")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    while known < end:
        step = min(32, end - known)
        differ = int.from_bytes(a[known : known + step], "big") ^ int.from_bytes(b[known : known + step], "big")
        if differ:
            return known + step - (differ.bit_length() + 7) // 8
        known += step
    return end


def front_coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bytes in common with the text before, lengths of the rests, and the rests of sorted texts."""
    shared, rests, before = [], [], b""
    for text in texts:
        n = common(before, text, 0)
        shared.append(n)
        rests.append(text[n:])
        before = text
    return np.array(shared, np.uint32), np.array([len(r) for r in rests], np.uint32), b"".join(rests)


def decoded(shared: list[int], sizes: list[int], rests: bytes):
    """Yield (common bytes with the one before, text)."""
    at, text = 0, b""
    for n, size in zip(shared, sizes, strict=True):
        text = text[:n] + rests[at : at + size]
        at += size
        yield n, text


def merged(runs: list) -> tuple[list[int], list[int]]:
    """Run of each text in ascending order, and its common prefix with the one before, by a loser tree.

    ``runs``: iterators of (common prefix with the run's text before, text).  A head's
    known prefix is the one it has with the last winner that passed its node; where two
    differ, the text of the longer one is the smaller.
    """
    k = len(runs)
    heads: list[bytes | None] = [None] * k
    known = [0] * k
    for r in range(k):
        known[r], heads[r] = next(runs[r], (0, None))
    losers = [-1] * k  # by inner node; the leaf of run r is node k + r

    def play(node: int, r: int) -> int:
        """The winner of run r and the loser at a node, which then holds the other."""
        s = losers[node]
        a, b = heads[r], heads[s]
        if b is None:
            return r
        if a is None:
            losers[node] = r
            return s
        if known[r] > known[s]:
            return r
        if known[r] < known[s]:
            losers[node] = r
            return s
        n = common(a, b, known[r])
        if a[n : n + 1] <= b[n : n + 1]:
            known[s] = n
            return r
        known[r] = n
        losers[node] = r
        return s

    winner = -1
    for r in range(k):  # the first round fills the nodes from the leaves up
        node, now = (k + r) >> 1, r
        while node and losers[node] >= 0:
            now = play(node, now)
            node >>= 1
        if node:
            losers[node] = now
        else:
            winner = now
    order, prefix = [], []
    while heads[winner] is not None:
        order.append(winner)
        prefix.append(known[winner])
        known[winner], heads[winner] = next(runs[winner], (0, None))
        node, now = (k + winner) >> 1, winner
        while node:
            now = play(node, now)
            node >>= 1
        winner = now
    return order, prefix


RUN_SCHEMA = "bucket int, shared binary, sizes binary, rests binary, before binary, near binary, far binary, one binary, two binary, counts binary"


def sorted_runs(texts: DataFrame, contested: np.ndarray, hot: np.ndarray | None, buckets: int, shape: Shape) -> DataFrame:
    """Front-coded sorted runs of the contested contexts of each task, cut by bucket; contexts alike are one, with a count."""
    sent = texts.sparkSession.sparkContext.broadcast((contested, hot))

    def run(batches):
        contested, hot = sent.value
        held: dict[tuple, list] = {}

        def flush():
            entries = sorted((bucket, right, near, far, one, two, before, n[0]) for (bucket, near, far, one, two), (right, before, n) in held.items())
            low, rows = 0, []
            while low < len(entries):
                high = low
                while high < len(entries) and entries[high][0] == entries[low][0]:
                    high += 1
                part = list(zip(*entries[low:high], strict=True))
                shared, sizes, rests = front_coded(list(part[1]))
                numbers = [np.array(part[i], kind).tobytes() for i, kind in ((2, np.uint32), (3, np.uint32), (4, np.int64), (5, np.int64), (7, np.int64))]
                rows.append((entries[low][0], shared.tobytes(), sizes.tobytes(), rests, b"".join(part[6]), *numbers))
                low = high
            held.clear()
            kinds = [pa.int32(), *[pa.binary()] * 9]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in RUN_SCHEMA.split(", ")])

        for batch in batches:
            for cut, *_ in slices(batch.column(0), shape):
                prefix = cut.prefixes()
                wanted = has_bit(contested, prefix)
                if hot is not None:
                    wanted &= ~has_bit(hot, prefix)
                some = np.flatnonzero(wanted)
                if not len(some):
                    continue
                near, far, one, two = cut.contexts(some)
                raw, x = cut.data.tobytes(), cut.x[some]
                bucket = (mix(prefix[some]) % U64(buckets)).astype(np.int64)
                for b, p, u, v, i, j in zip(bucket.tolist(), x.tolist(), near.tolist(), far.tolist(), one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True):
                    name = (b, u, v, i, j)
                    if name in held:
                        held[name][2][0] += 1
                    else:
                        held[name] = (raw[p : p + shape.length - u], raw[p - v : p][::-1], [1])
                if len(held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, RUN_SCHEMA)


def repeated_windows(prefix: np.ndarray, before: list[bytes], near: np.ndarray, far: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """[context, o]: whether the window that starts o bytes before each place has an equal one; contexts in the order of their suffixes."""
    n, top = len(near), int(far.max(initial=0))
    # the reversed bytes before each place in order, with their common prefixes
    width = -(-max(top, 1) // 8) * 8
    left = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in before), np.uint8).reshape(n, width)
    order = np.lexsort(left.view(">u8").astype(np.uint64).T[::-1])
    differ = left[order[1:]] != left[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    found = np.zeros((n, top + 1), bool)
    for o in range(int(near.min(initial=0)), top + 1):
        active = np.flatnonzero((near <= o) & (o <= far))
        if len(active) == 0:
            continue
        right_class = np.cumsum(prefix < length - o)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.concatenate([[0], np.cumsum(shared < o)])
        pair = right_class[active] * n + left_class[active]
        by = np.argsort(pair, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], pair[by][1:] != pair[by][:-1]]))
        total = np.add.reduceat(counts[active][by], head)
        found[active[by], o] = np.repeat(total > 1, np.diff(np.append(head, len(by))))
    return found


def runs_in(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge > 0)
    return row, first, np.nonzero(edge < 0)[1] - 1


def sorted_verdicts(runs: DataFrame, length: int) -> DataFrame:
    """(near, far, one, two, first, last): the windows, by o, of contested contexts that repeat."""

    def merge(table: pa.Table) -> pa.Table:
        numbers = {c: [np.frombuffer(v.as_buffer(), kind) for v in table[c]] for c, kind in (("near", np.uint32), ("far", np.uint32), ("one", np.int64), ("two", np.int64), ("counts", np.int64), ("shared", np.uint32), ("sizes", np.uint32))}
        heads = [decoded(a.tolist(), b.tolist(), bytes(v.as_buffer())) for a, b, v in zip(numbers["shared"], numbers["sizes"], table["rests"], strict=True)]
        order, prefix = merged(heads)
        run_of = np.array(order, np.int64)
        # a text's place among all texts of all runs: those of its run come in their order
        place = np.empty(len(run_of), np.int64)
        by_run = np.argsort(run_of, kind="stable")
        place[by_run] = np.arange(len(run_of))
        near, far, one, two, counts = (np.concatenate(numbers[c])[place].astype(np.int64) for c in ("near", "far", "one", "two", "counts"))
        every = b"".join(bytes(v.as_buffer()) for v in table["before"])
        widths = np.concatenate(numbers["far"]).astype(np.int64)
        starts = (np.cumsum(widths) - widths)[place]
        before = [every[a : a + w] for a, w in zip(starts.tolist(), far.tolist(), strict=True)]
        row, first, last = runs_in(repeated_windows(np.array(prefix, np.int64), before, near, far, counts, length))
        return pa.table([pa.array(near[row], pa.int32()), pa.array(far[row], pa.int32()), pa.array(one[row]), pa.array(two[row]), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*CONTEXT, "first", "last"])

    return runs.groupBy("bucket").applyInArrow(merge, "near int, far int, one long, two long, first int, last int").distinct()


def hot_windows(texts: DataFrame, hot: np.ndarray, shape: Shape) -> DataFrame:
    """(key, start, stop) of the repeated windows of hot prefixes, counted one by one."""
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            for cut, row, base, begin in slices(batch.column(1), shape):
                some = np.flatnonzero(has_bit(sent.value, cut.prefixes()))
                number = cut.high[some] - cut.low[some] + 1
                start = ragged(cut.low[some], number)
                piece = np.repeat(cut.piece[some], number)
                stop = start + shape.length
                arrays = [pa.array(hash_spans(cut.data, start, stop).view(np.int64)), pa.array(cut.hashed(start, stop).view(np.int64)), batch.column(0).take(pa.array(row[piece])), pa.array(start - begin[piece] + base[piece], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["one", "two", "key", "start"])

    rows = texts.select("key", "text").mapInArrow(run, "one long, two long, key binary, start long")
    rows = written(rows.groupBy("one", "two", "key", "start").agg(F.count(F.lit(1)).alias("n")), "hot-windows")
    several = rows.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two")
    return rows.join(several, ["one", "two"]).select("key", "start", (F.col("start") + shape.length).alias("stop"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(key, spans): the runs [start, stop) of bytes to remove of each text (key, text) that has any, ascending; they may overlap."""
    shape = Shape(length)
    found = candidates(texts, bitmap(prefix_counts(texts, shape), "prefix"), shape)
    contexts = written(found.groupBy("prefix", *CONTEXT).agg(F.sum("n").alias("n")), "contexts")
    of_prefix = written(contexts.groupBy("prefix").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n")).where("n > 1"), "prefix-contexts")
    single = of_prefix.where("contexts = 1").select("prefix")
    verdicts = contexts.where("n > 1").join(single, "prefix").select(*CONTEXT, F.col("near").alias("first"), F.col("far").alias("last"))
    sizes = of_prefix.where("contexts > 1").agg(F.sum(F.when(F.col("contexts") <= hot, F.col("contexts"))).alias("cool"), F.max("contexts").alias("most")).first()
    one_by_one = None
    if sizes["most"] is not None:
        crowded = bitmap(of_prefix.where(F.col("contexts") > hot).select("prefix"), "prefix") if sizes["most"] > hot else None
        runs = sorted_runs(texts, bitmap(of_prefix.where("contexts > 1").select("prefix"), "prefix"), crowded, max(1, (sizes["cool"] or 0) // BUCKET), shape)
        verdicts = verdicts.unionByName(sorted_verdicts(runs, length))
        one_by_one = hot_windows(texts, crowded, shape) if crowded is not None else None
    windows = found.join(written(verdicts, "verdicts"), CONTEXT).select("key", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + length).alias("stop"))
    if one_by_one is not None:
        windows = windows.unionByName(one_by_one)
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    return windows.groupBy("key").agg(spans.alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """Every document without the bytes that lie in a string of ``length`` bytes that also starts anywhere else.

    Returns ``id_col, kept, n_bytes, n_removed, n_spans, kept_sha256, spans``, one row
    per input row: kept, the bytes left, joined (null unless ``with_kept``); spans, the maximal removed runs
    [start, stop) of bytes.  Strings are judged on the input and may overlap; they lie
    in one document.  A null text counts as empty.  Repeated rows and ids are
    documents of their own (so of equal long texts nothing is left), null ids stay
    null, an empty table gives no rows, other columns are ignored.  Texts are named
    and contexts and single windows compared by 128 bits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key_of(F.col("text")))
    # as a table: the join then has an exchange of its own, in which Spark splits the copies of one text
    spans = written(repeated_spans(rows, length, hot), "spans").withColumnRenamed("key", "of")
    joined = rows.join(spans, F.col("key") == F.col("of"), "left").select("id", "text", "spans")
    span = "array<struct<start:bigint,stop:bigint>>"
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span}"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            column = batch.column(1).cast(pa.large_binary())
            for text, found in zip(column, batch.column(2), strict=True):
                raw = text.as_buffer()
                merged_spans: list[list[int]] = []
                if found.is_valid:
                    both = found.values
                    for a, b in zip(both.field("start").to_pylist(), both.field("stop").to_pylist(), strict=True):
                        if merged_spans and a <= merged_spans[-1][1]:
                            merged_spans[-1][1] = max(merged_spans[-1][1], b)
                        else:
                            merged_spans.append([a, b])
                view, at, pieces = memoryview(raw), 0, []
                for a, b in merged_spans:
                    pieces.append(view[at:a])
                    at = b
                pieces.append(view[at:])
                kept = b"".join(pieces)
                out.append((kept if with_kept else None, raw.size, raw.size - len(kept), len(merged_spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in merged_spans]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[id_col, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, schema)
