"""Deletion of passages that an earlier document has, by aligned lines (operator 10).

Lines are hashed.  A passage is a run of lines that stands in both documents and
has at least ``min_words`` words, or all the words of the later one.  Each line
of a passage lies in one of the shortest passages within it, those that no line
can leave at one end; a document has at most two a line.  For every shortest
passage that more than one document holds, each later holder is paired with the
first one, its only partner there, so a passage of a million holders makes a
million pairs, not their square, and none needs a cap.  Pairs are aligned by
patience diff: lines that occur once in either document anchor the alignment,
their longest increasing chain is kept, and equal lines next to anchors are
added.  What the chain leaves, moved and repeated passages, is aligned after it by
the shortest passages of both sides.  So a line goes if and only if it lies in a
passage of any earlier document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import STEP, U64, Words, hash_spans, list_array, mix, text_chunks
from .shared import unused, written

MIN_WORDS = 10
PRIME, RADIX = (1 << 61) - 1, 0x1B873593CC9E2D51


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = places(a, a0, a1), places(b, b0, b1)
        common = [(i, once_b[x]) for x, i in once_a.items() if i >= 0 and once_b.get(x, -1) >= 0]
        chain = increasing(common)
        if not chain:
            continue
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            work.append((i0 + 1, i1, j0 + 1, j1))
        out += chain
    return sorted(out)


def places(x: list[int], low: int, high: int) -> dict[int, int]:
    """Place of each line between low and high, -1 if it is there more than once; in order of place."""
    found: dict[int, int] = {}
    for i in range(low, high):
        found[x[i]] = -1 if x[i] in found else i
    return found


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first number, that increases in the second."""
    tops, at, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k:] = [j, *tops[k + 1 :]]
        at[k:] = [n, *at[k + 1 :]]
        back.append(at[k - 1] if k else -1)
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def shortest(lines: list[int], size: dict[int, int], enough: int) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs of ``enough`` words from each place and to each place, over lines with a size only."""
    out, low = [], 0
    for high in [i for i, x in enumerate(lines) if x not in size] + [len(lines)]:
        n, end = 0, low
        for start in range(low, high):
            while n < enough and end < high:
                n, end = n + size[lines[end]], end + 1
            if n < enough:
                break
            out.append((start, end))
            n -= size[lines[start]]
        n, start = 0, high
        for end in range(high, low, -1):
            while n < enough and start > low:
                n, start = n + size[lines[start - 1]], start - 1
            if n < enough:
                break
            out.append((start, end))
            n -= size[lines[end - 1]]
        low = high + 1
    return out


def run_hashes(lines: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Length and hash of each run; the hash of an empty line is 0."""
    total, power = [0], [1]
    for x in lines:
        total.append((total[-1] * RADIX + x) % PRIME)
        power.append(power[-1] * RADIX % PRIME)
    return [(end - start, (total[end] - total[start] * power[end - start]) % PRIME) for start, end in spans]


def moved(later: list[int], words: list[int], earlier: list[int], enough: int, gone: bytearray) -> list[tuple[int, int]]:
    """Passages of both sides, wherever they stand; none where no line that is left can lie in one."""
    both = set(earlier)
    n, left, possible = 0, False, False
    for i, x in enumerate(later):
        n, left = (n + words[i], left or not gone[i]) if x in both else (0, False)
        possible = possible or (left and n >= enough)
    if not possible:
        return []
    size = dict(zip(later, words, strict=True))
    known = set(run_hashes(earlier, shortest(earlier, size, enough)))
    spans = shortest(later, {x: n for x, n in size.items() if x in both}, enough)
    return [span for span, h in zip(spans, run_hashes(later, spans), strict=True) if h in known]


def common_blocks(later: list[int], words: list[int], earlier: list[int], min_words: int) -> list[tuple[int, int]]:
    """[start, end) of the later document's lines to delete."""
    enough = max(1, min(min_words, sum(words)))
    gone = bytearray(len(later))
    run: list[tuple[int, int]] = []
    for i, j in [*patience(later, earlier), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[run[0][0] : run[-1][0] + 1]) >= enough:
                gone[run[0][0] : run[-1][0] + 1] = b"\1" * len(run)
            run = []
        run.append((i, j))
    for start, end in moved(later, words, earlier, enough, gone):
        gone[start:end] = b"\1" * (end - start)
    edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.int8))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    half, low = U64(31), U64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return reduced(U64(2) * (ah * bh) + (middle >> U64(30)) + ((middle & (low >> U64(1))) << half) + al * bl)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
    return out[:n]


def running(x: np.ndarray) -> np.ndarray:
    """0 and the running sums of numbers below PRIME, modulo PRIME."""
    half = U64(31)
    high, low = np.cumsum(x >> half, dtype=np.uint64), np.cumsum(x & U64((1 << 31) - 1), dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), reduced(times(reduced(high), np.full(len(x), 1 << 31, np.uint64)) + reduced(low))])


def key_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def passages(hashes: np.ndarray, number: np.ndarray, text: np.ndarray, counts: np.ndarray, min_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, count a text) twice: of the shortest passages, and of the shorter runs that may be all the words of another text."""
    n, high = len(hashes), np.cumsum(counts)
    low = high - counts
    words = np.concatenate([[0], np.cumsum(number)])
    total = running(times(reduced(hashes), powers(RADIX, n)))
    back = powers(pow(RADIX, -1, PRIME), n + 1)

    def hashed(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = np.unique(start * (n + 1) + end)
        start, end = span // (n + 1), span % (n + 1)
        return mix(times(reduced(total[end] + U64(PRIME) - total[start]), back[start]) + (end - start).astype(np.uint64) * STEP), np.bincount(text[start], minlength=len(counts))

    at = np.arange(n)
    enough = np.clip(words[high] - words[low], 1, max(1, min_words))[text]
    end = np.searchsorted(words, words[:-1] + enough)
    start = np.searchsorted(words, words[1:] - enough, side="right") - 1
    ahead, behind = end <= high[text], start >= low[text]
    # of a text with fewer words than a passage, the run of all its words alone
    few = words[high] - words[low] < min_words
    inner = ~few[text] | (number > 0)
    ahead, behind = ahead & inner, behind & ~few[text]
    wanted = hashed(np.concatenate([at[ahead], start[behind]]), np.concatenate([end[ahead], at[behind] + 1]))
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    worded = np.flatnonzero(number > 0)
    for step in range(min(min_words - 1, len(worded))):
        a, b = worded[: len(worded) - step], worded[step:]
        short = (text[a] == text[b]) & (words[b + 1] - words[a] < min_words)
        starts.append(a[short])
        ends.append(b[short] + 1)
    return [wanted, hashed(np.concatenate(starts), np.concatenate(ends))]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(key, id, lines, words, wanted, parts): the hashed lines of every document, the words of each, and its passages."""
    hashes_ = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("lines", hashes_), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("wanted", hashes_), T.StructField("parts", hashes_)])

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2)):
                n = len(offsets) - 1
                words = Words(data, offsets)
                # a line begins at each text's start and after each line feed; a text without characters has one empty line
                feeds = np.flatnonzero(data == 10)
                owner = np.searchsorted(offsets, feeds, side="right") - 1
                begin = np.concatenate([offsets[:-1], feeds + 1])
                text = np.concatenate([np.arange(n), owner])
                order = np.lexsort((begin, text))
                begin, text = begin[order], text[order]
                counts = np.bincount(text, minlength=n)
                stop = np.empty_like(begin)
                stop[:-1] = begin[1:] - 1
                last = np.cumsum(counts) - 1
                stop[last] = offsets[1:]
                number = np.searchsorted(words.starts, stop) - np.searchsorted(words.starts, begin)
                hashes = hash_spans(data, begin, stop)
                runs = [list_array(h.view(np.int64), c, pa.int64()) for h, c in passages(hashes, number, text, counts, min_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), list_array(hashes.view(np.int64), counts, pa.int64()), list_array(number.astype(np.int32), counts, pa.int32()), *runs], names=schema.fieldNames())

    return docs.select(key_of(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def duplicate_blocks(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(key, blocks): the line ranges to delete, merged, of every document that has any."""
    table = written(line_table(docs, id_col, text_col, min_words), "lines")
    wanted = table.select("key", "id", F.explode(F.array_distinct("wanted")).alias("run"))
    parts = table.select("key", "id", F.explode(F.array_distinct("parts")).alias("run"))
    held = wanted.withColumn("wants", F.lit(True)).unionByName(parts.withColumn("wants", F.lit(False)))
    holder = F.struct("id", "key")
    first = held.groupBy("run").agg(F.min(holder).alias("first"), F.max(F.when(F.col("wants"), holder)).alias("last"))
    # as a table: the join below then has an exchange of its own, in which Spark splits a hot passage
    shared = written(first.where(F.col("first") != F.col("last")).select("run", F.col("first.key").alias("earlier")), "first-holders")
    pairs = wanted.join(shared, "run").where(F.col("key") != F.col("earlier")).select("key", "earlier").distinct()
    one = table.select("key", "lines", "words").dropDuplicates(["key"])
    sides = pairs.join(one.select(F.col("key").alias("earlier"), F.col("lines").alias("before")), "earlier").join(one, "key")
    schema = "key long, blocks array<struct<start:int,end:int>>"

    def run(batches):
        for batch in batches:
            keys, blocks = [], []
            for key, before, lines, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = common_blocks(lines, words, before, min_words)
                if found:
                    keys.append(key)
                    blocks.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["key", "blocks"])

    found = sides.select("key", "before", "lines", "words").mapInArrow(run, schema)
    return found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every document without the passages that an earlier one has, wherever they stand.

    Returns all columns of ``docs`` with the text as it is left (lines joined by
    line feeds), and ``lines_total, lines_deleted``.  Earlier means a smaller id,
    nulls first, then a smaller hash of the text.  Rows of one id and one text are
    one document and are left alike.  A null text stays null, an empty one empty;
    neither holds a line with words.  Lines without words go with a passage where
    they stand beside it in both; beside all the words of a document shorter than
    ``min_words``, where the first holder of these words has them so.  An empty
    table gives no rows.  Columns of ``docs`` of the names added here are replaced.

    The texts are read twice and shuffled once, with the deletions; the search
    moves a hash for each shortest passage.
    """
    found = duplicate_blocks(docs, id_col, text_col, min_words)
    key, blocks, total = unused(docs, "key", "blocks", "total")
    lines = F.split(F.col(text_col), "\n", -1)
    gone = lambda i: F.exists(F.col(blocks), lambda b: (i >= b["start"]) & (i < b["end"]))
    left = F.filter(lines, lambda _, i: ~gone(i))
    joined = docs.withColumn(key, key_of(id_col, text_col)).join(found.select(F.col("key").alias(key), F.col("blocks").alias(blocks)), key, "left")
    none = F.col(blocks).isNull()
    result = joined.withColumn(total, F.size(lines)).withColumn(text_col, F.when(none, F.col(text_col)).otherwise(F.array_join(left, "\n")))
    stays = F.aggregate(F.sequence(F.lit(0), F.col(total) - 1), F.lit(0), lambda n, i: n + F.when(gone(i), 0).otherwise(1))
    deleted = F.col(total) - F.when(none, F.col(total)).otherwise(stays)
    names = [c for c in docs.columns if c not in ("lines_total", "lines_deleted")]
    return result.select(*names, F.col(total).alias("lines_total"), deleted.alias("lines_deleted"))
