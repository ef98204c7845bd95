"""Byte-pair encoding by rank-synchronous array merging, and token counts (operator 8).

Pre-tokens are held as one ragged array of symbols.  In each round every
sequence merges all occurrences of its own lowest-ranked pair at once; a
sequence without a known pair leaves the array.  The symbols left are the tokens.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import HashMap, Packed, U64, WordCache, ragged, text_chunks
from .pretokens import cut_at, safe_cuts, split_words

NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the public byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class BpeTables:
    """A public BPE file as arrays.  pairs: (left, right) -> rank; made: the symbol made by each rank."""

    path: str
    pairs: HashMap
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    first: np.ndarray  # symbol of each byte
    last: np.ndarray  # symbol of a word's last byte
    specials: dict[str, int]
    byte_level: bool
    labels: list[str] = field(repr=False, default_factory=list)


@lru_cache(maxsize=4)
def load_tables(path: str) -> BpeTables:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [""] * (max([*vocab.values(), *specials.values()]) + 1)
    for token, i in [*vocab.items(), *specials.items()]:
        labels[i] = token
    letters = byte_letters()
    return BpeTables(
        path=path,
        pairs=HashMap(pair_keys(left, right), np.arange(len(merges))),
        left=left,
        right=right,
        made=made,
        first=np.array([vocab[c] for c in letters], dtype=np.int64),
        last=np.array([vocab[c + suffix] for c in letters], dtype=np.int64),
        specials=specials,
        byte_level=not suffix,
        labels=labels,
    )


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint64) + U64(1)) << U64(32)) | right.astype(np.uint64)


def merge_ragged(tables: BpeTables, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges every sequence to its end.  Returns the surviving symbols, sequence by sequence, and their counts."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    symbols = symbols.astype(np.int64)

    def ranks_at(at: np.ndarray, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        inside = at + 1 < len(symbols)
        nxt = np.where(inside, at + 1, at)
        rank = tables.pairs.get(pair_keys(symbols[at], symbols[nxt]))
        return np.where(inside & (owner[at] == owner[nxt]) & (rank >= 0), rank, NO_RANK)

    rank = ranks_at(np.arange(len(symbols)), symbols, owner)
    done_symbols, done_owner = [], []
    while len(symbols):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.minimum.reduceat(rank, head)
        size = np.diff(np.append(head, len(symbols)))
        open_ = lowest < NO_RANK
        if not open_.all():
            keep = np.repeat(open_, size)
            done_symbols.append(symbols[~keep])
            done_owner.append(owner[~keep])
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            lowest, size = lowest[open_], size[open_]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, size)
        at = np.flatnonzero(hit)
        # a run of overlapping places (aaa) merges every second one, from its left
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        order = np.arange(len(at)) - begin[run]
        same = symbols[at] == symbols[np.minimum(at + 1, len(symbols) - 1)]
        at = at[(order % 2 == 0) | ~same]
        symbols[at] = tables.made[rank[at]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # places after the deletions
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        touched = np.zeros(len(symbols), dtype=bool)
        touched[moved] = True
        touched[np.maximum(moved - 1, 0)] = True
        stale = np.flatnonzero(touched)
        rank[stale] = ranks_at(stale, symbols, owner)
    if not done_symbols:
        return np.empty(0, np.int64), np.zeros(n, np.int64)
    all_symbols, all_owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return all_symbols[order], np.bincount(all_owner, minlength=n)


class RankEncoder:
    """Encodes texts of a byte-level file; pre-tokens seen lately come from a bounded cache, by their bytes."""

    WIDTH = 8

    def __init__(self, path: str, ids: bool, cache_bits: int = 19):
        self.tables = load_tables(path)
        if not self.tables.byte_level:
            raise ValueError("the rank encoder reads byte-level files only")
        self.ids = ids
        self.cache = WordCache(cache_bits, self.WIDTH if ids else 0, np.uint16 if len(self.tables.labels) <= 1 << 16 else np.int32)

    def _merge_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        return merge_ragged(self.tables, self.tables.first[data[ragged(starts, size)]], size)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Token count of each pre-token; its ids in a row of WIDTH; ids of those that are longer."""
        packed = Packed(data, starts, ends)
        slot, hit = self.cache.slots(packed)
        counts = self.cache.counts[slot].astype(np.int64)
        rows = self.cache.rows[slot] if self.ids else None
        longer: dict[int, np.ndarray] = {}
        miss = np.flatnonzero(~hit)
        if len(miss):
            some, back = packed.distinct(miss)
            symbols, made = self._merge_words(data, starts[some], ends[some])
            counts[miss] = made[back]
            short = made <= self.WIDTH
            new_rows = None
            if self.ids:
                head = np.cumsum(made) - made
                new_rows = np.zeros((len(some), self.WIDTH), dtype=rows.dtype)
                fit = np.flatnonzero(short)
                place = ragged(np.zeros(len(fit), np.int64), made[fit])
                new_rows[np.repeat(fit, made[fit]), place] = symbols[ragged(head[fit], made[fit])]
                rows[miss] = new_rows[back]
                for j in np.flatnonzero(~short).tolist():
                    longer[j] = symbols[head[j] : head[j] + made[j]]
                if longer:
                    longer = {int(m): longer[b] for m, b in zip(miss.tolist(), back.tolist(), strict=True) if b in longer}
            self.cache.put(packed, some[short], made[short], new_rows[short] if self.ids else None)
        return counts, rows, longer

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        bounds, text, special = cut_at(data.tobytes(), offsets, self.tables.specials)
        starts, ends = split_words(data, bounds, True)
        whole = special >= 0
        piece = np.searchsorted(bounds, starts, side="right") - 1
        if whole.any():
            keep = ~whole[piece]
            marks = np.flatnonzero(whole)
            starts = np.concatenate([starts[keep], bounds[marks]])
            ends = np.concatenate([ends[keep], bounds[marks + 1]])
            value = np.concatenate([np.full(int(keep.sum()), -1), special[marks]])
            order = np.argsort(starts, kind="stable")
            return starts[order], ends[order], value[order]
        return starts, ends, None

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if len(offsets) == 2 and len(data) > PART_BYTES:  # a long text, part by part
            return np.array([sum(int(self._count(data[a:b], np.array([0, b - a]))[0]) for a, b in safe_cuts(data, PART_BYTES))])
        return self._count(data, offsets)

    def _count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, special = self._pieces(data, offsets)
        counts, _, _ = self.words(data, starts, ends)
        if special is not None:
            counts[special >= 0] = 1
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's count."""
        if len(offsets) == 2 and len(data) > PART_BYTES:
            parts = [self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in safe_cuts(data, PART_BYTES)]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, special = self._pieces(data, offsets)
        counts, rows, longer = self.words(data, starts, ends)
        if special is not None:
            marks = special >= 0
            counts[marks] = 1
            rows[marks, 0] = special[marks]
            longer = {k: v for k, v in longer.items() if not marks[k]}
        total = np.concatenate([[0], np.cumsum(counts)])
        if longer:
            ids = np.empty(total[-1], dtype=np.uint32)
            short = np.ones(len(counts), dtype=bool)
            short[list(longer)] = False
            fit = np.flatnonzero(short)
            ids[ragged(total[fit], counts[fit])] = rows[np.repeat(fit, counts[fit]), ragged(np.zeros(len(fit), np.int64), counts[fit])]
            for k, v in longer.items():
                ids[total[k] : total[k + 1]] = v
        else:
            ids = rows[np.arange(self.WIDTH) < counts[:, None]].astype(np.uint32)
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


#: Bytes of text encoded at once; a worker's peak memory follows it.  A longer text is cut into parts of about PART_BYTES where words end.
ENCODE_BYTES, PART_BYTES = 1 << 19, 1 << 20


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> RankEncoder:
    """One counting encoder for all tasks of a Python worker."""
    return RankEncoder(path, ids=False)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token counts of every whole text.

    Returns ``id_col, n_bytes, n_tokens, over_limit``, one row per input row:
    repeated and null ids stay as they are, a null text counts as empty (0 bytes,
    0 tokens), other columns are ignored whatever they are called, an empty table
    gives no rows.  A text of any length is counted whole, part by part; only a
    single word of more than a megabyte takes memory in proportion to itself.  One
    pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            size, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for row, data, offsets in text_chunks(texts, ENCODE_BYTES):
                size[row : row + len(offsets) - 1] = np.diff(offsets)
                tokens[row : row + len(offsets) - 1] = encoder.count(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)
