"""Product codes of vectors by delta-maintained Lloyd rounds (operator 11).

Components become integers, floor(scale * x); a vector is cut into consecutive
parts, and each part position has a codebook, at first that part of the rows of
the smallest ids.  The assignments of a round are a table in the shared folder.
The next round reads them as the previous ones, and shuffles contributions only
of parts whose entry has changed: plus at the new entry, minus at the old one,
summed by task before they are shuffled, so a task sends at most a row for each
number of the codebooks.  The driver holds the running sums and counts, as many
as the codebooks have numbers, and never a row.

All is exact: sums travel as limbs of 32 bits; distances are products of doubles
where every sum of them is below 2**53, and Python integers elsewhere.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import list_array
from .shared import drop_folder, written, written_at

EXACT = float(1 << 53)
LIMB = 32
#: Rows that distances are computed for at a time.
ROWS = 2048
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold integers, or Python integers where a product overflows."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.isfinite(y).all():
        return y
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def whole(x: np.ndarray) -> np.ndarray:
    """As Python integers."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def nearest(y: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties to the lower index) and its squared distance."""
    n, width = y.shape
    exact = y.dtype != object and book.dtype != object
    if exact:
        reach = float(np.abs(y).max(initial=0)) + float(np.abs(book).max(initial=0))
        exact = width * reach < EXACT and width * reach * reach < EXACT
    if not exact:
        y, book = whole(y), whole(book)
    index, error = np.zeros(n, np.int64), np.zeros(n, np.float64 if exact else object)
    squares = (book * book).sum(axis=1)
    for low in range(0, n, ROWS if exact else 16):
        part = y[low : low + (ROWS if exact else 16)]
        distance = squares - 2 * (part @ book.T) + (part * part).sum(axis=1)[:, None]
        best = np.argmin(distance, axis=1)
        index[low : low + len(part)], error[low : low + len(part)] = best, distance[np.arange(len(part)), best]
    return index, error


def cuts(length: int, parts: int) -> list[int]:
    return [length * k // parts for k in range(parts + 1)]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), length)


def finite(x: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True))


def assigned(state: DataFrame, books: list[np.ndarray], length: int, scale: int) -> DataFrame:
    """(id, label, x, old, new): ``new`` of the state becomes ``old``."""
    sent = state.sparkSession.sparkContext.broadcast(books)  # entries * length numbers
    codes = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(state.schema[c] for c in ("id", "label", "x")), T.StructField("old", codes), T.StructField("new", codes)])
    bounds = cuts(length, len(books))

    def run(batches):
        for batch in batches:
            y = integers(matrix(batch.column(2), length), scale)
            new = np.stack([nearest(y[:, a:b], book)[0] for a, b, book in zip(bounds, bounds[1:], sent.value, strict=False)], axis=1)
            counts = np.full(len(y), len(books))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], list_array(new.astype(np.int32).ravel(), counts, pa.int32())], names=schema.fieldNames())

    return state.select("id", "label", "x", "new").mapInArrow(run, schema)


def deltas(state: DataFrame, sizes: list[int], length: int, scale: int) -> DataFrame:
    """(part, entry, place, limb, delta) of the parts that changed; place -1: the count."""
    parts = len(sizes)
    bounds = cuts(length, parts)

    def run(batches):
        total = [np.zeros((n, b - a + 1), dtype=object) for n, a, b in zip(sizes, bounds, bounds[1:], strict=False)]
        for batch in batches:
            y = integers(matrix(batch.column(0), length), scale)
            small = y.dtype != object and float(np.abs(y).max(initial=0)) * max(len(y), 1) < float(1 << 62)
            y = y.astype(np.int64) if small else whole(y)
            ones = np.ones((len(y), 1), dtype=y.dtype)
            new = batch.column(2).flatten().to_numpy().reshape(-1, parts)
            old = np.full_like(new, -1) if batch.column(1).null_count else batch.column(1).flatten().to_numpy().reshape(-1, parts)
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                moved = np.flatnonzero(old[:, k] != new[:, k])
                terms = np.concatenate([ones[moved], y[moved, a:b]], axis=1)
                change = np.zeros(total[k].shape, dtype=y.dtype)
                np.add.at(change, new[moved, k], terms)
                left = old[moved, k] >= 0
                np.subtract.at(change, old[moved[left], k], terms[left])
                total[k] += change
        rows = []
        for k, table in enumerate(total):
            for entry, place in zip(*np.nonzero(table), strict=True):
                value = int(table[entry, place])
                sign, rest, limb = (1 if value > 0 else -1), abs(value), 0
                while rest:
                    rows.append((k, int(entry), int(place) - 1, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "entry", "place", "limb", "delta"])

    changed = state.where("old IS NULL OR old <> new").select("x", "old", "new")
    # the first round has null for all, later ones for none: a batch is never mixed
    return changed.mapInArrow(run, "part int, entry int, place int, limb int, delta long").groupBy("part", "entry", "place", "limb").agg(F.sum("delta").alias("delta"))


@dataclass
class VectorCodes:
    """``codes``: (id, label, code, error) of every kept row; ``codebooks``: of each part position the entries, Python integers."""

    codes: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        numbers = (str(v) for book in self.codebooks for entry in book.tolist() for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4) -> VectorCodes:
    """Codes of all vectors, and the codebooks they refer to.

    Rows whose vector is null or holds a null or a non-finite component are dropped.
    The length of vectors is that of the smallest kept id; vectors of another length
    keep their row with null code and error.  Parts are equal where the length is a
    multiple of ``parts``, else as alike as can be.  Null ids come last and repeated
    ids in the order of their vectors where the first entries are chosen; every row
    has a code of its own.  Fewer rows than ``entries`` give smaller codebooks, an
    empty table no rows.  An error beyond a long is null.  Other columns are ignored.
    """
    spark = df.sparkSession
    label = F.col(label_col) if label_col in df.columns else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("x")).where(finite(F.col("x")))
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    if not first:
        return VectorCodes(rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [])
    length = len(first[0]["x"])
    first = [r["x"] for r in first if len(r["x"]) == length]
    bounds = cuts(length, parts)
    start = whole(integers(np.array(first, dtype=np.float64).reshape(len(first), length), scale))
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    counts = [np.zeros(len(first), dtype=object) for _ in books]
    sums = [np.zeros(b.shape, dtype=object) for b in books]

    fit = F.size("x") == length
    state, at = rows.where(fit).withColumn("new", F.lit(None).cast("array<int>")), None
    for _ in range(rounds):
        state, next_at = written_at(assigned(state, [sendable(b) for b in books], length, scale), "codes")
        if at:
            drop_folder(spark, at)
        at, changes = next_at, 0
        for r in deltas(state, [len(b) for b in books], length, scale).collect():  # at most the numbers of the codebooks, by their limbs
            part, entry, place, value = r["part"], r["entry"], r["place"], r["delta"] << (LIMB * r["limb"])
            if place < 0:
                counts[part][entry] += value
            else:
                sums[part][entry, place] += value
            changes += 1
        if not changes:  # no part has moved: further rounds change nothing
            break
        for book, n, total in zip(books, counts, sums, strict=True):
            for entry in range(len(book)):
                if n[entry]:
                    book[entry] = [v // n[entry] for v in total[entry]]
    sent = spark.sparkContext.broadcast([sendable(b) for b in books])
    schema = T.StructType([state.schema["id"], state.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            y = integers(matrix(batch.column(2), length), scale)
            found = [nearest(y[:, a:b], book) for a, b, book in zip(bounds, bounds[1:], sent.value, strict=False)]
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
            error = [sum(int(v) for v in row) for row in zip(*(f[1].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array([e if e <= LONG else None for e in error], pa.int64())], names=["id", "label", "code", "error"])

    codes = state.select("id", "label", "x").mapInArrow(run, schema)
    other = rows.where(~fit).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return VectorCodes(written(codes.unionByName(other), "vector-codes"), books)


def sendable(book: np.ndarray) -> np.ndarray:
    """A codebook as doubles, where they hold it."""
    exact = all(abs(v) < (1 << 53) for v in book.ravel().tolist())
    return book.astype(np.float64) if exact else book


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together (null beyond a long)."""
    sums = written(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
