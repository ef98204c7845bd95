"""Array kernels on the UTF-8 buffers of Arrow string columns.

Python never sees a text as a str here: words, lines and shingles are found
and hashed by NumPy on the bytes, a few megabytes at a time.  A span's hash is a
sum of non-linear functions of its pieces of eight bytes and their places, so
texts of a pattern (Thue-Morse words, say) do not meet as they do in polynomials
modulo a power of two.  Where an answer must not rest on hashes, as in the word
caches, bytes are compared (``Packed``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = U64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20
#: The first n bytes of a piece of eight, n from 0 to 8.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (64-bit murmur constants)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first_row, bytes, offsets) over slices of about ``limit`` bytes.

    A null counts as empty.  A text longer than ``limit`` is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes that separate words: space and U+0009 to U+000D.
BLANK = table_of((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the license scan's words: everything but ASCII that is no letter or digit.
LETTERS = ~table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a document begins."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(n + 1, dtype=bool)
    new[offsets[:-1]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | new[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | new[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def pieces(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each ``at`` on as one number; bytes past ``size`` count as 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    return every[at] & _HEADS[np.clip(size, 0, 8)]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    size = ends - starts
    number = (size + 7) >> 3
    place = ragged(np.zeros(len(starts), np.int64), number)
    at = np.repeat(starts, number) + 8 * place
    left = np.repeat(size, number) - 8 * place
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(mix(mix(pieces(data, at, left) + STEP) ^ (place.astype(np.uint64) * U64(BASE))), out=total[1:])
    high = np.cumsum(number)
    return mix((total[high] - total[high - number]) + mix(size.astype(np.uint64) + U64(BASE)))


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First span of each document, and one past the last: len(offsets) entries."""
    return np.searchsorted(starts, offsets[:-1], side="left").tolist() + [len(starts)]


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items."""
    n = len(items) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * STEP + items[j : j + n]
    return mix(out + U64(k))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of range(start, start + count)."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class HashMap:
    """Fixed map from uint64 keys to int64 values; open addressing, probed by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys)) + 1))))
        self.shift = U64(64 - bits)
        size = 1 << bits
        self.keys = np.zeros(size, dtype=np.uint64)
        self.values = np.full(size, -1, dtype=np.int64)
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.values[at] < 0
            # the last writer of a slot wins; the others move on
            self.keys[at[free]] = keys[left[free]]
            self.values[at[free]] = values[left[free]]
            done = self.keys[at] == keys[left]
            done &= self.values[at] >= 0
            left = left[~done]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(BASE)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        slot, left, mask = self._slot(keys), None, len(self.keys) - 1
        found, value = self.keys[slot], self.values[slot]
        hit = (found == keys) & (value >= 0)
        out[hit] = value[hit]
        left = np.flatnonzero(~hit & (value >= 0))
        while len(left):
            slot_left = (slot[left] + 1) & mask
            slot[left] = slot_left
            found, value = self.keys[slot_left], self.values[slot_left]
            hit = (found == keys[left]) & (value >= 0)
            out[left[hit]] = value[hit]
            left = left[~hit & (value >= 0)]
        return out


class Packed:
    """Words of a chunk with their bytes in ``PIECES`` numbers each; longer words are ``wide``."""

    PIECES = 4

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.size = ends - starts
        self.wide = self.size > 8 * self.PIECES
        self.bytes = np.stack([pieces(data, np.minimum(starts + 8 * k, len(data)), self.size - 8 * k) for k in range(self.PIECES)], axis=1)
        self.keys = hash_spans(data, starts, ends)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes; False where they are too long to tell."""
        return (self.size[a] == self.size[b]) & ~self.wide[a] & (self.bytes[a] == self.bytes[b]).all(axis=1)

    def distinct(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that stand for all of ``some``, and the place of each one's stand-in among them."""
        _, first, back = np.unique(self.keys[some], return_index=True, return_inverse=True)
        other = np.flatnonzero(~self.same(some, some[first[back]]))
        other = other[some[first[back[other]]] != some[other]]
        back[other] = len(first) + np.arange(len(other))
        return np.concatenate([some[first], some[other]]), back


class WordCache:
    """Direct-mapped cache from a word's bytes to a short row of integers; bounded, newer wins."""

    def __init__(self, bits: int, width: int, dtype=np.int32):
        self.shift, self.width = U64(64 - bits), width
        self.size = np.full(1 << bits, -1, dtype=np.int16)
        self.bytes = np.zeros((1 << bits, Packed.PIECES), dtype=np.uint64)
        self.counts = np.zeros(1 << bits, dtype=np.int32)
        self.rows = np.zeros((1 << bits, width), dtype=dtype) if width else None

    def slots(self, words: Packed) -> tuple[np.ndarray, np.ndarray]:
        slot = (words.keys >> self.shift).astype(np.int64)
        return slot, (self.size[slot] == words.size) & (self.bytes[slot] == words.bytes).all(axis=1) & ~words.wide

    def put(self, words: Packed, some: np.ndarray, counts: np.ndarray, rows: np.ndarray | None) -> None:
        some_ = ~words.wide[some]
        some, counts = some[some_], counts[some_]
        slot = (words.keys[some] >> self.shift).astype(np.int64)
        self.size[slot], self.bytes[slot], self.counts[slot] = words.size[some], words.bytes[some], counts  # of several for one slot the last stays, in all arrays
        if rows is not None:
            self.rows[slot] = rows[some_]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Words:
    """Words of a chunk of texts: spans, hashes and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~BLANK):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = spans(inside[data], offsets)
        self.hashes = hash_spans(data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows of k words that lie in one text, their first words, and their number in each text."""
        n = np.maximum(self.counts - k + 1, 0)
        at = ragged(self.bounds[:-1], n)
        hashes = window_hashes(self.hashes, k)
        return (hashes[at] if len(at) else np.empty(0, np.uint64)), at, n


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return np.diff(total[bounds])
