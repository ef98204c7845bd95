"""N-gram Jaccard join, size-aware, heavy and light (operator 2).

Sets are a document's distinct k-word shingles.  Documents with equal sets are
one class; only classes are joined.

Small sets enumerate their subsets: if sets of sizes s and t link, they share a
subset of need(s, t) shingles, and sharing one is a link.  In the list of a subset
all links run through its smallest set, so a star there keeps every component.

Large sets are found by inverted lists.  All sets follow one order of shingles:
those of one document first, then those of several, then heavy ones (of more than
``HEAVY`` documents).  Two linked sets share a shingle among the first
s - ceil(0.8 s) + 1 of each; shingles of one document need no list.  Which class a
shingle is in is read from bitmaps of bounded size; a wrong bit changes the order
alike for all sets and costs time only.  Lists link their members to the most
central one first; then members that are not connected yet are compared with
all others of their lists that size and place in the order allow.  Candidates are
verified with whole sets.  Copies and heavy lists so need no pair within one
component, and no list is cut.

The texts are read and cut into shingles once; all steps read the written sets.

The boundary between small and large is chosen by cost from the histogram of
sizes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U64, Words, list_array, lower_ascii, mix, ragged, text_chunks
from .components import components
from .shared import unused, written

SHINGLE = 5
#: Similarity as a fraction: 100 * common >= PERCENT * union.
PERCENT = 80
HEAVY = 64
#: Rows that a candidate of an inverted list costs on its way to verification, for the boundary.
LIST_COST = 8
LARGEST_BOUNDARY = 12
#: Bits of the bitmap of shared shingles, at most (32 MB); the heavy one has an eighth.
MAX_BITS = 28
#: Shingles that one task of the count gets, about.
COUNT_TASK = 1 << 21


def need(s, t, percent: int = PERCENT):
    """Shingles that linked sets of sizes s and t have in common at least."""
    return -(-(percent * (s + t)) // (100 + percent))


def prefix(s, percent: int = PERCENT):
    """Length of the part of a set in which any set that links with it meets it."""
    return s - -(-(percent * s) // 100) + 1


def text_sets(column: pa.Array):
    """Yield (row, counts, shingles): each text's distinct shingles in the order of their hashes."""
    for row, data, offsets in text_chunks(column):
        words = Words(lower_ascii(data), offsets)
        hashes, _, n = words.windows(SHINGLE)
        few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        owner = np.repeat(np.arange(len(n)), n)
        if len(few):  # the whole sequence as one shingle
            whole = np.zeros(len(few), np.uint64)
            for j in range(SHINGLE - 1):
                has = words.counts[few] > j
                whole[has] = mix(whole[has] * U64(0xD6E8FEB86659FD93) + words.hashes[words.bounds[few[has]] + j] + U64(1))
            hashes, owner = np.concatenate([hashes, mix(whole + words.counts[few].astype(np.uint64))]), np.concatenate([owner, few])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
            hashes, owner = hashes[new], owner[new]
        yield row, np.bincount(owner, minlength=len(n)), hashes


def set_names(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set."""
    ends = np.cumsum(counts)
    total = np.concatenate([[U64(0)], np.cumsum(mix(shingles + U64(0x51ED270B)), dtype=np.uint64)])
    return (mix((total[ends] - total[ends - counts]) * U64(0x9E3779B97F4A7C15) + counts.astype(np.uint64)) >> U64(1)).astype(np.int64)


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_shingles, name, shingles) of every document; key: a hash of its text; the shingles' hashes in ascending order as unsigned numbers."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("name", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for row, counts, shingles in text_sets(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(counts)) for c in batch.columns[:2]), pa.array(counts, pa.int64()), pa.array(set_names(shingles, counts)), list_array(shingles.view(np.int64), counts, pa.int64())], names=schema.fieldNames())

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sets_of(column: pa.Array, limit: int = 1 << 18):
    """Yield (row, counts, shingles) of a column of sets, about ``limit`` shingles at a time."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, np.diff(offsets[row : end + 1]).astype(np.int64), values[offsets[row] : offsets[end]]
        row = end


def small_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest size at which enumerating subsets, for all sets up to it, costs no more than their inverted lists."""
    best, small, lists = 0, 0, 0
    for s in range(1, LARGEST_BOUNDARY + 1):
        n = sizes.get(s, 0) + 1e-9
        small += n * sum(comb(s, c) for c in range(-(-percent * s // 100), s + 1))
        lists += n * prefix(s, percent) * (1 + LIST_COST)
        if small <= lists:
            best = s
    return best


def packed(ascending: np.ndarray) -> bytes:
    """Steps of ascending 32-bit numbers, the first bytes of all, then the second ones and so on: the last are zeros, which compress."""
    return np.diff(ascending, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def shared_bitmaps(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the shingles (by their first bits) that several documents have, and of those that more than HEAVY have.

    Each task sends every shingle it has once, with a count, some 3 bytes each; the
    counts are merged by ranges of the hashes.
    """
    bits = min(MAX_BITS, max(16, int(total).bit_length()))
    parts = max(4, int(np.ceil(np.log2(max(1, total / COUNT_TASK)))) + 1)
    parts = min(parts, bits - 6)

    def send(batches):
        keys, counts = [], []
        size = 0

        def flush():
            every, number = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            order = np.argsort(every)
            every, number = every[order], number[order]
            head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            every, number = every[head], np.minimum(np.add.reduceat(number, head), 255).astype(np.uint8)
            part = (every >> U64(64 - parts)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << parts) + 1))
            rest = ((every << U64(parts)) >> U64(32)).astype(np.uint32)
            some = [p for p in range(1 << parts) if cut[p] < cut[p + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([packed(rest[cut[p] : cut[p + 1]]) for p in some], pa.binary()), pa.array([number[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "rest", "n"]
            )

        for batch in batches:
            for _, _, shingles in sets_of(batch.column(0)):
                unique, n = np.unique(shingles, return_counts=True)
                keys.append(unique)
                counts.append(n)
                size += len(unique)
                if size > 1 << 21:
                    yield flush()
                    keys, counts, size = [], [], 0
        if size:
            yield flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rest = np.concatenate([unpacked(x.as_buffer()) for x in table["rest"]])
        number = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["n"]])
        order = np.argsort(rest)
        rest, number = rest[order], number[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        rest, number = rest[head], np.add.reduceat(number, head)
        out = []
        for size, least in ((bits, 2), (bits - 3, HEAVY + 1)):
            own = size - parts  # bits of a place within this part
            field = np.zeros(1 << own, dtype=bool)
            field[rest[number >= least] >> np.uint32(32 - own)] = True
            out.append(np.packbits(field).tobytes())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out[0]], pa.binary()), pa.array([out[1]], pa.binary())], names=["part", "several", "heavy"])

    sent = sets.select("shingles").mapInArrow(send, "part int, rest binary, n binary")
    several, heavy = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 6), np.uint8)
    for row in sent.groupBy("part").applyInArrow(merge, "part int, several binary, heavy binary").collect():  # 36 MB at most
        for field, raw in ((several, row["several"]), (heavy, row["heavy"])):
            field[row["part"] * len(raw) : (row["part"] + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    return several, heavy


def has_bit(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U64(64 - int(len(field)).bit_length() + 1 - 3)
    return (field[(at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8)) & 1 > 0


def list_entries(sets: DataFrame, several: np.ndarray, heavy: np.ndarray, least: int, percent: int) -> DataFrame:
    """(x, name, size, place): the part of every set of ``least`` shingles and more that inverted lists need."""
    fields = sets.sparkSession.sparkContext.broadcast((several, heavy))

    def run(batches):
        some, much = fields.value
        for batch in batches:
            for row, counts, shingles in sets_of(batch.column(1)):
                names = batch.column(0).slice(row, len(counts)).to_numpy()
                owner = np.repeat(np.arange(len(counts)), counts)
                kind = has_bit(some, shingles).astype(np.int64)
                kind += has_bit(much, shingles) & (kind > 0)
                order = np.lexsort((kind, owner))  # keeps the order of the hashes within a kind
                kind, shingles = kind[order], shingles[order]
                place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                size = counts[owner]
                take = np.flatnonzero((kind > 0) & (place < prefix(size, percent)) & (size >= least))
                yield pa.RecordBatch.from_arrays([pa.array(shingles[take].view(np.int64)), pa.array(names[owner[take]]), pa.array(size[take], pa.int32()), pa.array(place[take], pa.int32())], names=["x", "name", "size", "place"])

    return sets.where(F.col("n_shingles") >= least).select("name", "shingles").mapInArrow(run, "x long, name long, size int, place int").distinct()


def subset_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(a, b) of linked small sets: a star for each subset."""

    def run(batches):
        for batch in batches:
            keys, names, sizes, subset = [], [], [], []
            for row, counts, shingles in sets_of(batch.column(1)):
                head = np.cumsum(counts) - counts
                name = batch.column(0).slice(row, len(counts)).to_numpy()
                for i in range(len(counts)):
                    own, s = shingles[head[i] : head[i] + counts[i]], int(counts[i])
                    for c in range(-(-percent * s // 100), s + 1):
                        picks = np.array(list(combinations(range(s), c)))
                        keys.append(mix(np.bitwise_xor.reduce(mix(own + U64(c)), axis=0, keepdims=True)) if c == s else mix(np.bitwise_xor.reduce(mix(own[picks] + U64(c)), axis=1)))
                        subset += [c] * len(picks)
                        names += [int(name[i])] * len(picks)
                        sizes += [s] * len(picks)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(subset, pa.int32()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "c", "name", "size"])

    small = sets.where(F.col("n_shingles").between(1, boundary)).select("name", "shingles").dropDuplicates(["name"])
    rows = small.mapInArrow(run, "key long, c int, name long, size int")
    center = rows.groupBy("key", "c").agg(F.min(F.struct("size", "name")).alias("m"), F.max(F.struct("size", "name")).alias("far")).where(F.col("m") != F.col("far"))
    joined = rows.join(center, ["key", "c"]).where((F.col("name") != F.col("m.name")) & (need_column(F.col("size"), F.col("m.size"), percent) <= F.col("c")))
    return joined.select(F.col("m.name").alias("a"), F.col("name").alias("b")).distinct()


def need_column(s: Column, t: Column, percent: int) -> Column:
    return F.ceil((F.lit(percent) * (s + t)) / F.lit(100 + percent))


def possible(percent: int, boundary: int) -> Column:
    """Whether entries l and r of one list can link with the list's shingle as the first in common; pairs of small sets are none of its business."""
    need_ = need_column(F.col("l.size"), F.col("r.size"), percent)
    return (F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place")) >= need_) & (F.least("l.size", "r.size") >= need_) & (F.greatest("l.size", "r.size") > boundary)


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of names that link, by their whole sets."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    # a bitmap of the wanted names, 65536 rows at most, spares the other sets the shuffle; the joins below are exact
    # (a semi-join with the names here would be moved before the bitmap, and shuffle all sets)
    place, bit = F.shiftright("name", 47).cast("int"), F.shiftright("name", 41).bitwiseAND(63).cast("int")
    bitmap = wanted.groupBy(place.alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    marked = sets.select("name", "shingles").join(F.broadcast(bitmap), place == F.col("place")).where(F.call_function("shiftright", "bits", bit).bitwiseAND(1) == 1)
    sets = written(marked.select("name", "shingles").dropDuplicates(["name"]), "sets")
    left = pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
    # in the JVM: pairs of long sets would be Arrow batches of any size
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def link_components(sets: DataFrame, sizes: dict[int, int], total: int, percent: int) -> DataFrame:
    """(node, root) over the names of all sets that link with another one.  sizes: number of small sets; total: shingles of all sets."""
    boundary = small_boundary(sizes, percent)
    several, heavy = shared_bitmaps(sets, total)
    least = need(boundary + 1, boundary + 1, percent) if boundary else 1
    least = min(least, -(-percent * (boundary + 1) // 100))
    entries = written(list_entries(sets, several, heavy, least, percent), "entries")
    lists = entries.groupBy("x").agg(F.min(F.struct("place", "size", "name")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    l = entries.alias("l").join(lists.select("x", F.struct(F.col("m.name").alias("name"), F.col("m.size").alias("size"), F.col("m.place").alias("place")).alias("r")), "x")
    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = l.where((F.col("l.name") != F.col("r.name")) & possible(percent, boundary)).select(*order("l.name", "r.name"))
    links = written(verify(sets, stars, percent).union(subset_links(sets, boundary, percent)), "star-links")
    first = components(links)
    # members of a list outside its center's component, against all members of other components
    labelled = entries.join(lists.select("x", F.col("m.name").alias("center")), "x")
    labelled = labelled.join(first.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    labelled = written(labelled.join(first.select(F.col("node").alias("center"), F.col("root").alias("main")), "center", "left").select("x", "name", "size", "place", "root", F.coalesce("main", "center").alias("main")), "labelled")
    apart = labelled.where("root <> main").alias("l").join(labelled.alias("r"), (F.col("l.x") == F.col("r.x")) & (F.col("l.root") != F.col("r.root")) & possible(percent, boundary))
    again = apart.select(*order("l.name", "r.name")).distinct().join(links.select(*order("a", "b")), ["a", "b"], "left_anti")
    more = written(verify(sets, again, percent), "more-links")
    return components(links.union(more)) if more.limit(1).count() else first


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, key, n_shingles, root, component_id, class_size), one row per input row; root names the component, null for an empty set."""
    names = written(document_sets(docs, id_col, text_col), "sets-of-documents")
    full = names.where("n_shingles > 0")
    classes = written(full.groupBy("name").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("class_size"), F.first("n_shingles").alias("n")), "classes")
    rows = classes.groupBy(F.least("n", F.lit(LARGEST_BOUNDARY + 1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).collect()
    if rows:
        roots = link_components(full, {r["n"]: r["k"] for r in rows if r["n"] <= LARGEST_BOUNDARY}, sum(r["total"] for r in rows), percent)
        rooted = classes.join(roots.withColumnRenamed("node", "name"), "name")
        lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
        classes = classes.join(rooted.select("name", "root").join(lowest, "root"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), F.coalesce("lowest", "low").alias("component_id"), "class_size")
    else:
        classes = classes.select("name", F.col("name").alias("root"), F.col("low").alias("component_id"), "class_size")
    columns = ["id", "key", "n_shingles", "root", "component_id", "class_size"]
    empty = names.where("n_shingles = 0").select("id", "key", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return full.join(classes, "name").select(*columns).unionByName(empty)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Near duplicates among all documents.

    Returns ``id_col, n_shingles, component_id, class_size``, one row per input row.
    component_id is the smallest id that links reach (links: 100 * common >=
    percent * union of the sets), class_size the number of documents with the same
    set.  A text without words, or null, has an empty set, links with nothing and
    keeps its own id; repeated ids and rows are documents of their own; a null id
    is never the smallest unless all are null; an empty table gives no rows; other
    columns are ignored.  Sets are compared by 64-bit hashes of their shingles.
    """
    return near_duplicates(docs, id_col, text_col, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "class_size")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one document of each component: that of the smallest id, and of its texts the one of the smallest hash.

    All columns stay.  Texts without words, and null ids, stay.  Rows alike in id
    and text count as one document, of which one row stays; rows that share an id
    only are documents of their own.
    """
    found = written(near_duplicates(docs, id_col, text_col, percent), "near-copies").where(F.col("id").isNotNull() & F.col("root").isNotNull())
    stays = found.groupBy("root").agg(F.min(F.struct("id", "key")).alias("stays"))
    # as a table its size is known: the few ids of a small one are sent to the texts, not the texts to them
    id_, key_, text_ = unused(docs, "id", "key", "text_key")
    gone = written(found.join(stays, "root").where(F.struct("id", "key") != F.col("stays")).select(F.col("id").alias(id_), F.col("key").alias(key_)).distinct(), "gone")
    key = F.xxhash64(text_col)
    same = (F.col(id_col) == F.col(id_)) & (key == F.col(key_))
    kept = docs.join(gone, same, "left_anti").select(docs.columns)
    repeated = written(found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(id_), F.col("key").alias(key_)), "repeated")
    if repeated.limit(1).count() == 0:
        return kept
    once = kept.join(repeated, same, "left_semi").withColumn(text_, key).dropDuplicates([id_col, text_]).select(docs.columns)
    return kept.join(repeated, same, "left_anti").select(docs.columns).unionByName(once)
