"""Log-bilinear language model trained by noise-contrastive estimation (operator 9).

Tokens are words (A-Z lower-cased) and an end.  Counts are taken over all
training documents.  Every token has a class: the most frequent words and the end
have one each, all other words, known or not, that of their last three bytes, by a
hash.  The number of classes grows with the vocabulary up to a parameter (``MAX_CLASSES``).  The
model predicts the class w from the classes a, b of the two tokens before:

    logit(w | a, b) = R[w] . (C1 * Q[a] + C2 * Q[b]) + bias[w]

and within a class a word has its smoothed share.  Training documents are dealt
into shards of about ``SHARD_TOKENS`` tokens by a hash of their ids and texts, so
neither the table's partitions nor the number of tasks is seen by the model.  In
each of ``ROUNDS`` rounds every shard is gone over in NumPy with noise-contrastive
estimation against the class unigrams, all from one start, and the parameters and
step sizes are averaged by tokens.

Scoring is exactly normalised: the sum over all classes factors into
(exp(R.C1Q + bias)) @ exp(R.C2Q)^T, one matrix product for all pairs of contexts.

Counts of the at most ``MAX_FREQUENT`` most frequent tokens travel to the tasks as
arrays; the occurrences of all other tokens (the long tail) are joined with the
table of counts.  So nothing that is broadcast grows without a bound.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import HashMap, Words, U64, lower_ascii, mix, pieces, sums, text_chunks
from .shared import written

FOLDS, HELD_OUT = 7, 2
#: Classes of frequent words, and of all other words' ends, at most each; a quarter as many as there are words, if that is less.
MAX_CLASSES, DIMENSIONS = 1023, 16
NOISE, BATCH, RATE, FIRST_SQUARE = 48, 1024, 0.15, 1e-5
ROUNDS, SHARD_TOKENS, SHUFFLE_TOKENS = 2, 1 << 20, 1 << 17
MAX_FREQUENT = 200_000
#: Class of the end; words' classes follow, then those of word ends; the context before a text is the number of classes.
END = 0
_END_HASH = mix(np.array([0x656E64], np.uint64))[0]


def is_held_out(ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()], dtype=bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, ends included, 16-bit codes of their last bytes, and each text's bounds."""
    words = Words(lower_ascii(data), offsets)
    n = len(words.counts)
    bounds = words.bounds + np.arange(n + 1)
    out, tail = np.empty(bounds[-1], np.uint64), np.zeros(bounds[-1], np.int64)
    last = np.zeros(len(out), dtype=bool)
    last[bounds[1:] - 1] = True
    out[~last] = words.hashes
    out[last] = _END_HASH
    begin = np.maximum(words.ends - 3, words.starts)
    tail[~last] = (mix(pieces(words.data, begin, words.ends - begin) + U64(7)) >> U64(48)).astype(np.int64)
    return out, tail, bounds


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def training_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, tail, n) of every token of the training documents, summed by task before they are shuffled."""

    def run(batches):
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def fold():
            every, tail, number = (np.concatenate([x[j] for x in waiting]) for j in range(3))
            order = np.argsort(every)
            every, tail, number = every[order], tail[order], number[order]
            head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            return every[head], tail[head], np.add.reduceat(number, head)

        def rows():
            keys, tail, number = fold()
            for i in range(0, len(keys), 1 << 16):
                some = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([signed(keys[some]), pa.array(tail[some].astype(np.int32)), pa.array(number[some])], names=["hash", "tail", "n"])

        for batch in batches:
            learn = ~is_held_out(batch.column(0))
            for row, data, offsets in text_chunks(batch.column(1)):
                hashes, tail, bounds = tokens(data, offsets)
                take = np.flatnonzero(np.repeat(learn[row : row + len(bounds) - 1], np.diff(bounds)))
                if not len(take):
                    continue
                keys, first, number = np.unique(hashes[take], return_index=True, return_counts=True)
                waiting.append((keys, tail[take[first]], number))
                size += len(keys)
                if size > 1 << 20:
                    waiting = [fold()]
                    size = len(waiting[0][0]) // 2
                if len(waiting[0][0]) > 1 << 21:  # a partition of any size: what is counted so far goes out
                    yield from rows()
                    waiting, size = [], 0
        if waiting:
            yield from rows()

    return docs.select(id_col, text_col).mapInArrow(run, "hash long, tail int, n long").groupBy("hash", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the frequent tokens, the totals over all tokens, and the classes."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    least: int  # all tokens that occur this often are in it
    own: np.ndarray  # hashes of the tokens with a class each, the end first
    ends: int  # classes of word ends
    sizes: np.ndarray  # training tokens of each class
    words: np.ndarray  # distinct ones of each class

    @property
    def classes(self) -> int:
        return len(self.sizes)

    def lookup(self) -> HashMap:
        return HashMap(self.own, np.arange(len(self.own)))

    def labels(self, lookup: HashMap, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        own = lookup.get(hashes)
        return np.where(own >= 0, own, len(self.own) + tail % self.ends)


def vocabulary_of(counts: DataFrame, limit: int = MAX_FREQUENT, max_classes: int = MAX_CLASSES) -> Vocabulary:
    """At most ``limit`` tokens, all that occur at least so often; found by a histogram of counts on a logarithmic scale."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect(), reverse=True)
    total, distinct = sum(r["n"] for r in rows), sum(r["k"] for r in rows)
    held, lowest = 0, None
    for r in rows:
        if held + r["k"] > limit:
            break
        held, lowest = held + r["k"], r["step"]
    hashes, number, tail, least = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 1 << 62
    if lowest is not None:
        least = counts.where(step >= lowest).agg(F.min("n")).first()[0]
        table = counts.where(F.col("n") >= least).toArrow()
        hashes, number, tail = table["hash"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["tail"].to_numpy().astype(np.int64)
    most = int(np.clip(distinct // 4, 1, max_classes))
    order = np.lexsort((hashes, -number))
    order = order[hashes[order] != _END_HASH][:most]
    own = np.concatenate([[_END_HASH], hashes[order]])
    sizes, words = np.zeros(len(own) + most, np.int64), np.zeros(len(own) + most, np.int64)
    for code, n, k in counts.where(F.col("hash") != int(_END_HASH.astype(np.int64))).groupBy(F.pmod("tail", F.lit(most))).agg(F.sum("n"), F.count(F.lit(1))).collect():
        sizes[len(own) + code], words[len(own) + code] = n, k
    np.subtract.at(sizes, len(own) + tail[order] % most, number[order])
    np.subtract.at(words, len(own) + tail[order] % most, 1)
    sizes[1 : len(own)], words[: len(own)] = number[order], 1
    sizes[END] = total - sizes[1:].sum()
    return Vocabulary(hashes, number, total, distinct, least, own, most, sizes, words)


@dataclass
class Model:
    """Parameters, and the sums of squares that their step sizes follow from."""

    q: np.ndarray
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(sizes: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(9))
        n = len(sizes)
        unigram = np.log((sizes + 1) / (sizes.sum() + n))
        small = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
        return Model(small(n + 1, DIMENSIONS), small(n, DIMENSIONS), np.ones(DIMENSIONS, np.float32), np.ones(DIMENSIONS, np.float32), unigram.astype(np.float32))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.q, self.r, self.c1, self.c2, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def of(flat: np.ndarray, classes: int) -> Model:
        flat, out, at = flat.astype(np.float32), [], 0
        for shape in ((classes + 1, DIMENSIONS), (classes, DIMENSIONS), (DIMENSIONS,), (DIMENSIONS,), (classes,)):
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape).copy())
            at += n
        return Model(*out)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """log P(w | a, b) = first[a, w] + second[b, w] - norm[a, b]."""
        return (self.q * self.c1) @ self.r.T + self.bias, (self.q * self.c2) @ self.r.T

    def norm(self) -> np.ndarray:
        first, second = (x.astype(np.float64) for x in self.halves())
        high1, high2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        return (np.log(np.exp(first - high1) @ np.exp(second - high2).T) + high1 + high2.T).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes; noise is shared by a batch."""

    def __init__(self, model: Model, squares: Model, sizes: np.ndarray, seed: int):
        self.m, self.squares = model, squares
        self.rng = np.random.Generator(np.random.PCG64(seed))
        p = (sizes + 1) / (sizes.sum() + len(sizes))
        self.shift = np.log(NOISE * p).astype(np.float32)
        self.edges = np.cumsum(p)
        self.waiting, self.held, self.seen = [], 0, 0

    def feed(self, triples: np.ndarray) -> None:
        """Rows of contexts and class; they are mixed in groups of about SHUFFLE_TOKENS."""
        self.waiting.append(triples)
        self.held += triples.shape[1]
        if self.held >= SHUFFLE_TOKENS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            triples = np.concatenate(self.waiting, axis=1)
            triples = triples[:, self.rng.permutation(triples.shape[1])]
            for i in range(0, triples.shape[1], BATCH):
                self.step(*triples[:, i : i + BATCH])
            self.seen += self.held
            self.waiting, self.held = [], 0

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        qa, qb, rw, rn = m.q[a], m.q[b], m.r[w], m.r[noise]
        h = qa * m.c1 + qb * m.c2
        data = np.einsum("ij,ij->i", h, rw) + m.bias[w] - self.shift[w]
        false = h @ rn.T + (m.bias - self.shift)[noise]
        up = 1 / (1 + np.exp(np.clip(data, -30, 30)))  # pulls the data's logits up
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))  # pushes the noise's down
        dh = up[:, None] * rw + down @ rn
        out, of_out = summed(np.concatenate([w, noise]), np.concatenate([np.column_stack([up[:, None] * h, up]), np.column_stack([down.T @ h, down.sum(axis=0)])]))
        into, of_in = summed(np.concatenate([a, b]), np.concatenate([dh * m.c1, dh * m.c2]))
        every = slice(None)
        grads = ((into, of_in), (out, of_out[:, :-1]), (every, (dh * qa).sum(axis=0)), (every, (dh * qb).sum(axis=0)), (out, of_out[:, -1]))
        for x, s, (at, g) in zip(m.parts(), self.squares.parts(), grads, strict=True):
            g = (g / BATCH).astype(np.float32)
            s[at] += g * g
            x[at] += RATE * g / np.sqrt(s[at])


def summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index once, with the sum of its rows."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    head = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[head], np.add.reduceat(rows[order], head, axis=0)


def contexts(label: np.ndarray, bounds: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token two before and the one before; ``before`` where a text begins."""
    one = np.empty_like(label)
    one[1:] = label[:-1]
    first = bounds[:-1]
    one[first] = before
    two = np.empty_like(label)
    two[1:] = one[:-1]
    two[first] = before
    return two, one


def shards_of(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(shard, h, classes): the training documents as classes, two bytes a token, dealt by hash; copies of a document go to shards in turn."""
    shards = max(1, round(vocabulary.total / SHARD_TOKENS))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        lookup, met = v.lookup(), {}
        for batch in batches:
            learn = ~is_held_out(batch.column(1))
            keys = batch.column(0).to_pylist()
            for row, data, offsets in text_chunks(batch.column(2)):
                hashes, tail, bounds = tokens(data, offsets)
                label = v.labels(lookup, hashes, tail).astype("<u2")
                shard, h, body = [], [], []
                for i in np.flatnonzero(learn[row : row + len(bounds) - 1]).tolist():
                    key = keys[row + i]
                    again = met[key] = met.get(key, -1) + 1
                    shard.append((key + again) % shards)
                    h.append(key)
                    body.append(label[bounds[i] : bounds[i + 1]].tobytes())
                if len(met) > 1 << 18:
                    met.clear()
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(h, pa.int64()), pa.array(body, pa.binary())], names=["shard", "h", "classes"])

    return docs.select(F.xxhash64(id_col, text_col).alias("h"), id_col, text_col).mapInArrow(run, "shard int, h long, classes binary")


def train(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, rounds: int = ROUNDS) -> Model:
    """A model from all training documents; ``rounds`` passes."""
    classes, sizes = vocabulary.classes, vocabulary.sizes
    model = Model.start(sizes)
    squares = Model.of(np.full(len(model.flat()), FIRST_SQUARE), classes)
    if not vocabulary.total:
        return model
    table = written(shards_of(docs, vocabulary, id_col, text_col), "shards")
    tasks = min(4096, max(1, round(vocabulary.total / SHARD_TOKENS)))
    for turn in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast((model.flat(), squares.flat()))

        def run(batches, start=start, turn=turn):
            total, seen, trainer, at = np.zeros(2 * len(start.value[0])), 0, None, None

            def close():
                trainer.flush()
                return trainer.seen * np.concatenate([trainer.m.flat(), trainer.squares.flat()]), trainer.seen

            for batch in batches:
                for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if shard != at:
                        if trainer:
                            x, n = close()
                            total, seen = total + x, seen + n
                        trainer, at = Trainer(*(Model.of(x, classes) for x in start.value), sizes, 1_000_003 * turn + shard), shard
                    w = np.frombuffer(raw.as_buffer(), "<u2").astype(np.int64)
                    trainer.feed(np.stack([*contexts(w, np.array([0, len(w)]), classes), w]))
            if trainer:
                x, n = close()
                total, seen = total + x, seen + n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), seen))], names=["i", "x", "n"])

        ordered = table.repartition(tasks, "shard").sortWithinPartitions("shard", "h").select("shard", "classes")
        rows = ordered.mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        flat = np.empty(2 * len(model.flat()))
        flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
        model, squares = (Model.of(x, classes) for x in np.split(flat, 2))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, max_frequent: int = MAX_FREQUENT, max_classes: int = MAX_CLASSES) -> tuple[DataFrame, Vocabulary, Model]:
    """The table of training counts, the vocabulary, and the trained model; max_classes: words with a class each, and classes of word ends (codes take two bytes)."""
    if not 1 <= max_classes < 1 << 15:
        raise ValueError(f"max_classes is from 1 to {(1 << 15) - 1}")
    counts = written(training_counts(docs, id_col, text_col), "token-counts")
    vocabulary = vocabulary_of(counts, max_frequent, max_classes)
    return counts, vocabulary, train(docs, vocabulary, id_col, text_col, rounds)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, max_frequent: int = MAX_FREQUENT, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Scores every whole text.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, one row per input row: repeated and null ids stay (a null id is in
    training), a null or empty text is its end alone, an empty table gives no
    rows, other columns are ignored.  ``max_classes``: see ``fit``.

    The texts are read three times and never shuffled; training reads and deals
    two bytes a token.  Counts and parameters are summed by task first.
    """
    spark = docs.sparkSession
    counts, vocabulary, model = fit(docs, id_col, text_col, rounds, max_frequent, max_classes)
    total = vocabulary.total
    base_floor = float(np.log10(total + vocabulary.distinct + 1))
    shared = spark.sparkContext.broadcast((vocabulary, model, model.norm()))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
    fields += [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "row")]
    fields += [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("tail", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields)

    def run(batches):
        v, m, norm = shared.value
        lookup, own = HashMap(v.hashes, np.arange(len(v.hashes))), v.lookup()
        first, second = m.halves()
        floor = np.log10(v.sizes + v.words + 1)
        numbers = np.append(v.counts, 0)  # the last one is for tokens that are not known here
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = is_held_out(batch.column(0))
            for row, data, offsets in text_chunks(batch.column(1)):
                token, tail, bounds = tokens(data, offsets)
                n = len(bounds) - 1
                at = lookup.get(token)
                known = at >= 0
                seen = np.log10(numbers[at] + 1)
                w = v.labels(own, token, tail)
                a, b = contexts(w, bounds, v.classes)
                log10 = (first[a, w] + second[b, w] - norm[a, b]) / np.log(10)
                # an end that is no frequent token gets log10(c + 1) from the join below, which its class has already
                share = np.where(w >= len(v.own), seen - floor[w], np.where(known, 0, -np.log10(v.sizes[END] + 1)))
                base = seen - base_floor
                miss = np.flatnonzero(~known)
                owner = np.searchsorted(bounds, miss, side="right") - 1
                order = np.lexsort((token[miss], owner))
                t, o = token[miss][order], owner[order]
                head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])) if len(t) else np.empty(0, np.int64)
                times = np.diff(np.append(head, len(t))).astype(np.int32)
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(o[head], minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(out[row : row + n]),
                        pa.array(np.diff(bounds)),
                        pa.array(sums(known, bounds)),
                        pa.array(np.arange(row_id, row_id + n)),
                        pa.array(sums(base, bounds)),
                        pa.array(sums(log10 + share, bounds)),
                        pa.ListArray.from_arrays(lists, signed(t[head])),
                        pa.ListArray.from_arrays(lists, pa.array(times)),
                    ],
                    names=schema.fieldNames(),
                )
                row_id += n

    scored = written(docs.select(id_col, text_col).mapInArrow(run, schema), "scored")
    tail = scored.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.times").alias("times"))
    # (the tail's tokens that training knows; each occurrence adds log10(c + 1) to both scores)
    rare = counts.where(F.col("n") < F.lit(vocabulary.least))
    added = tail.join(rare, "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1))).alias("gain"))
    full = scored.drop("tail", "times").join(added, "row", "left")
    gain = F.coalesce(F.col("gain"), F.lit(0.0))
    return full.select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("more"), F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score")
    )
