"""Quality rules and a hashed n-gram likelihood ratio (operator 7).

Words fall into ``WORD_BUCKETS`` buckets by their hashes, pairs of words into
``PAIR_BUCKETS``.  Two multinomials over the buckets are counted: one from all
documents, one from trusted documents (labelled good and not toxic; at most
``max_trusted`` of them, those of the smallest hashed ids).  A bucket's log ratio
counts where it is large (``LEAST_RATIO``) and the trusted count is further from its
expectation than chance would take it (``DEVIATIONS``); elsewhere it is 0, so rare
words say nothing.

A document's ratio is the lowest mean of log ratios over its windows of ``WINDOW_WORDS``
words (over all words, if it has fewer): normalised by length, and a bad passage is
not hidden by a long text around it.  It is held against a fixed threshold: the same
for every document, at every size of the corpus, without random choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import Words, U64, hash_spans, mix, ragged, sums, table_of, text_chunks

WORD_BUCKETS, PAIR_BUCKETS = 1 << 20, 1 << 16
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
#: Added to observed and expected counts.
PRIOR = 2.0
#: Standard deviations that a trusted count must be away from its expectation, and the log ratio's least size.
DEVIATIONS, LEAST_RATIO = 4.0, 2.0
MAX_TRUSTED = 20_000
WINDOW_WORDS = 30
#: Documents with a window of a lower mean log ratio are rejected.
THRESHOLD = -0.2
#: The symbols that the rules count.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = table_of(*((ord(c), ord(c)) for c in SYMBOLS))


def grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs; the first word of each pair."""
    pairs, at, _ = words.windows(2)
    bucket = lambda hashes, n: (hashes >> U64(65 - n.bit_length())).astype(np.int64)
    return bucket(words.hashes, WORD_BUCKETS), WORD_BUCKETS + bucket(pairs, PAIR_BUCKETS), at


def gram_counts(docs: DataFrame, trusted: list, id_col: str, text_col: str) -> DataFrame:
    """(bucket, raw, target) over all documents; trusted: ids, of the type of the documents' ones."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            known = pc.is_in(batch.column(0), value_set=pa.array(trusted, batch.column(0).type)).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets)
                good = known[row : row + len(words.counts)][words.text_of()]
                one, two, at = grams(words)
                for found, mark in ((one, good), (two, good[at])):
                    np.add.at(raw, found, 1)
                    np.add.at(target, found[mark], 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counted = docs.select(id_col, text_col).mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame, id_col: str, max_trusted: int, kind: T.DataType) -> list:
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col(id_col).try_cast(kind).alias(id_col)).dropna().distinct()
    return [r[0] for r in good.orderBy(F.xxhash64(id_col), id_col).limit(max_trusted).collect()]


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """Log ratio of every bucket.  Without trusted documents all are 0, and the method rejects nothing."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rows = gram_counts(docs, trusted_ids(labels, id_col, max_trusted, docs.schema[id_col].dataType), id_col, text_col).toArrow()  # at most BUCKETS rows
    raw[rows["bucket"].to_numpy()], target[rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return log_ratios(raw, target)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's trusted count and its expectation, 0 where they differ by chance."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return np.where((np.abs(ratio) >= LEAST_RATIO) & (np.abs(target - expected) >= DEVIATIONS * np.sqrt(expected + 1)), ratio, 0.0)


def rule_counts(words: Words) -> dict[str, np.ndarray]:
    """The base figures of every text of a chunk."""
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.add.at(inside, words.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    points = inside & ((data & 0xC0) != 0x80)
    # repeated windows: values met twice among (window, text) hashes
    hashes, at, number = words.windows(WINDOW)
    salt = mix(np.arange(n, dtype=np.uint64) + U64(1))
    keys = hashes ^ np.repeat(salt, number)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    covered = np.zeros(len(words.starts) + 1, np.int32)
    if len(twice):
        twice = np.unique(twice)
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[place] == keys]
        covered[hit] += 1
        covered[hit + WINDOW] -= 1
    covered = np.cumsum(covered[:-1]) > 0
    # lines: cut at line feeds and where texts begin
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10)
    filled = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
    begin, stop = begin[filled], stop[filled]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    line = hash_spans(data, begin, stop) ^ salt[owner] if len(begin) else np.empty(0, np.uint64)
    order = np.argsort(line, kind="stable")
    again = order[1:][line[order[1:]] == line[order[:-1]]]
    return {
        "n_words": words.counts,
        "word_chars": sums(points, offsets),
        "n_symbols": sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(owner[again], minlength=n),
        "n_repeat_words": sums(covered, words.bounds),
    }


def lowest_windows(score: np.ndarray, words: Words) -> np.ndarray:
    """Lowest mean of the words' scores over windows of WINDOW_WORDS words, or over all words of a shorter text; 0 without words."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    size = np.minimum(words.counts, WINDOW_WORDS)
    number = np.where(words.counts > 0, words.counts - size + 1, 0)
    begin = ragged(words.bounds[:-1], number)
    width = np.repeat(size, number)
    out = np.zeros(len(words.counts))
    some = np.flatnonzero(number)
    if len(some):
        out[some] = np.minimum.reduceat((total[begin + width] - total[begin]) / width, np.cumsum(number)[some] - number[some])
    return out


def verdicts(words: Words, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Figures, failure of the base rules and lowest windows' log ratio of every text of a chunk."""
    figures = rule_counts(words)
    one, two, at = grams(words)
    score = weight[one]
    score[at] += weight[two]
    failed = (figures["n_words"] < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * figures["n_words"])
    return figures, failed, lowest_windows(score, words)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """The rows of ``docs`` that the rules and the ratio keep, with all their columns; edge cases as in quality_rules."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, labels, id_col, text_col, max_trusted))
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(place)):
                _, failed, mean = verdicts(Words(data, offsets), ratio.value)
                yield batch.slice(row, len(mean)).filter(pa.array(~failed & (mean >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Figures and verdict of every document.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_ratio, kept``, one row per input row: repeated and null ids
    stay (a null id is never trusted), a null or empty text has no words and
    fails, an empty table gives no rows, other columns are ignored.  Labels may be
    empty, repeated or null; a document counts as trusted if any row calls it so.

    log_ratio is that of the lowest window.  Two passes over the texts; the shuffle
    carries at most BUCKETS rows a task.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, labels, id_col, text_col, max_trusted))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("log_ratio", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        weight = ratio.value
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                figures, failed, mean = verdicts(Words(data, offsets), weight)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(mean)), *(pa.array(figures[c], pa.int64()) for c in names), pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= threshold))],
                    names=schema.fieldNames(),
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
