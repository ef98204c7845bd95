"""BPE by a deterministic automaton over the merges (operator 1).

Construction.  Start with one state and an arc for every base symbol.  The
gadget of the i-th merge (u, v) -> w takes the arc v from the state that u leads
to, and lays an arc w beside every path u v, to where v leads.  All arcs of one
label lead to one state, so a state is known by the label before it, and the
automaton after i gadgets is kept as versions: ``lost[(u, v)] = i`` is the
version in which v leaves the state of u, ``born[w]`` the one in which w appears.
An arc w leaves the state of u in the finished automaton exactly if no version
took away the arcs of which w and u are made; that is read off by walking both
labels back through the versions in which they appeared.

The finished automaton has hundreds of millions of arcs; its transition table is
compiled where texts need it: ``table[u, w]`` says whether an arc w leaves the
state of u, and a row once compiled is only looked up.  Every state accepts and
each text has one path, so each prefix of a word ends in one state.  Encoding
steps through a word by the table: from each place it takes the longest label
there that the table allows, and a place from which no path reaches the end is
closed, so none is entered twice and the time is linear in the word.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import Packed, WordCache, ragged
from .pretokens import safe_cuts, split_words
from .rank_merge import BpeTables, load_tables

NEVER = 1 << 40
#: Stands for the end of a word after its letters, which are bytes as code points 0 to 255.
WORD_END = chr(256)
HEAD = 4
#: Arcs that a process keeps compiled; beyond it the table begins anew.
TABLE_ARCS = 1 << 21
#: Texts are encoded in groups of about so many letters, and a longer text is cut where words end.
GROUP_LETTERS = 1 << 21


class Automaton:
    """Versioned automaton of one merge list, its table of arcs, and its labels by their letters."""

    def __init__(self, tables: BpeTables):
        n = max(len(tables.labels), int(tables.made.max()) + 1)
        self.born, self.left, self.right = [0] * n, list(range(n)), list(range(n))
        self.lost: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}  # u << 32 | w
        spelled = {int(s): chr(i) for i, s in enumerate(tables.first)} | {int(s): chr(i) + WORD_END for i, s in enumerate(tables.last)}
        for version, (u, v, w) in enumerate(zip(tables.left.tolist(), tables.right.tolist(), tables.made.tolist(), strict=True), 1):
            self.lost[u, v] = version
            self.born[w], self.left[w], self.right[w] = version, u, v
            spelled[w] = spelled[u] + spelled[v]
        self.label = {letters: w for w, letters in spelled.items()}
        self.longest: dict[str, int] = {}  # letters of the longest label by its first HEAD letters
        for letters in self.label:
            head = letters[:HEAD]
            self.longest[head] = max(len(letters), self.longest.get(head, 0))

    def has_arc(self, u: int, w: int) -> bool:
        """Whether the state after label u has an arc w, from the versions."""
        version = NEVER
        born, lost = self.born, self.lost
        while True:
            if lost.get((u, w), NEVER) < version:
                return False
            bu, bw = born[u], born[w]
            if not (bu or bw):
                return True
            # within one version the leftmost place merges first, so the arc on the right counts one version longer
            if bu > bw:
                version, u = bu, self.right[u]
            else:
                version, w = bw + 1, self.left[w]

    def arc(self, u: int, w: int) -> bool:
        """The entry of u and w in the transition table, compiled at its first use."""
        known = self.table.get(u << 32 | w)
        if known is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            known = self.table[u << 32 | w] = self.has_arc(u, w)
        return known

    def encode(self, word: str) -> list[int]:
        """Labels of the one path over a word's letters and its end."""
        n = len(word)
        label, table, longest = self.label.get, self.table.get, self.longest
        path, at, closed = [], 0, set()
        back: list[tuple[int, int]] = []  # places passed, and the next end to try from each
        before, end = -1, min(n, longest.get(word[:HEAD], HEAD - 1))
        while at < n:
            while end > at:
                w = label(word[at:end])
                if w is not None and end not in closed:
                    if before < 0:
                        break
                    allowed = table(before << 32 | w)
                    if allowed or (allowed is None and self.arc(before, w)):
                        break
                end -= 1
            if end > at:
                path.append(w)
                back.append((at, end - 1))
                before, at = w, end
                end = min(n, at + longest.get(word[at : at + HEAD], HEAD - 1))
            else:  # a dead end: the place is closed
                closed.add(at)
                path.pop()
                at, end = back.pop()
                before = path[-1] if path else -1
        return path


@lru_cache(maxsize=2)
def load_automaton(path: str) -> Automaton:
    return Automaton(load_tables(path))


class WordEncoder:
    """Encodes whole texts with a word-end BPE file; words seen lately come from a bounded cache, by their bytes."""

    WIDTH = 8

    def __init__(self, path: str, cache_bits: int = 19):
        self.automaton = load_automaton(path)
        self.tables = load_tables(path)
        if self.tables.byte_level:
            raise ValueError("the automaton encoder reads files with word ends only")
        self.cache = WordCache(cache_bits, self.WIDTH)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.tables.specials)) + ")")
        self.labels = [x.encode() for x in self.tables.labels]
        self.decimals = [str(i).encode() for i in range(len(self.labels))]
        self.late = regex.compile("[\u0590-\U0010ffff]")
        self.library = None

    def normalize(self, text: str) -> bytes:
        """NFC and lower case as the file asks; white space is dropped later, so its folding is not needed."""
        if not text.isascii() and self.late.search(text):
            # letters that Python's tables may know in another version than the library's
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.tables.path).normalizer
            return self.library.normalize_str(text).encode()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().encode()

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the count of each word."""
        packed = Packed(data, starts, ends)
        slot, hit = self.cache.slots(packed)
        counts = self.cache.counts[slot].astype(np.int64)
        rows = self.cache.rows[slot]
        miss = np.flatnonzero(~hit)
        longer: dict[int, list[int]] = {}
        if len(miss):
            some, back = packed.distinct(miss)
            raw = data.tobytes().decode("latin-1")
            labels = [self.automaton.encode(raw[a:b] + WORD_END) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            made = np.array([len(x) for x in labels], dtype=np.int64)
            counts[miss] = made[back]
            fit = np.flatnonzero(made <= self.WIDTH)
            new_rows = np.zeros((len(some), self.WIDTH), dtype=np.int32)
            new_rows[np.repeat(fit, made[fit]), ragged(np.zeros(len(fit), np.int64), made[fit])] = [w for b in fit.tolist() for w in labels[b]]
            rows[miss] = new_rows[back]
            self.cache.put(packed, some[fit], made[fit], new_rows[fit])
            wide = made > self.WIDTH
            if wide.any():
                longer = {int(m): labels[b] for m, b in zip(miss.tolist(), back.tolist(), strict=True) if wide[b]}
        if not longer:
            return rows[np.arange(self.WIDTH) < counts[:, None]], counts
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(total[-1], dtype=np.int32)
        fit = np.ones(len(counts), dtype=bool)
        fit[list(longer)] = False
        fit = np.flatnonzero(fit)
        ids[ragged(total[fit], counts[fit])] = rows[np.repeat(fit, counts[fit]), ragged(np.zeros(len(fit), np.int64), counts[fit])]
        for k, v in longer.items():
            ids[total[k] : total[k + 1]] = v
        return ids, counts

    def pieces(self, texts: list[str]) -> tuple[list[bytes], list[int], dict[int, int]]:
        """Normalized pieces, the text of each, and the ids of those that are special strings."""
        pieces, owner, marks = [], [], {}
        for i, text in enumerate(texts):
            for part in self.special.split(text) if "<|" in text else (text,):
                if part in self.tables.specials:
                    marks[len(pieces)] = self.tables.specials[part]
                    part = ""
                raw = self.normalize(part)
                cuts = safe_cuts(np.frombuffer(raw, np.uint8), GROUP_LETTERS) if len(raw) > GROUP_LETTERS else [(0, len(raw))]
                pieces += [raw[a:b] for a, b in cuts]
                owner += [i] * len(cuts)
        return pieces, owner, marks

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, special strings as their own ids."""
        pieces, owner, marks = self.pieces(texts)
        found: list[np.ndarray] = []
        while len(found) < len(pieces):
            row, size = len(found), 0
            group = []
            while row < len(pieces) and (not group or size + len(pieces[row]) <= GROUP_LETTERS):
                group.append(pieces[row])
                row, size = row + 1, size + len(pieces[row])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in group])]).astype(np.int64)
            data = np.frombuffer(b"".join(group), dtype=np.uint8)
            starts, ends = split_words(data, offsets, False)
            ids, counts = self.words(data, starts, ends)
            bound = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)].tolist()
            found += [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        if len(pieces) == len(texts) and not marks:
            return found
        for j, special in marks.items():
            found[j] = np.array([special], np.int32)
        first = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        return [np.concatenate(found[a:b]) if b > a else np.empty(0, np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, as the library joins them where a file has no decoder."""
        return b" ".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def digest(ids: np.ndarray, names: list[bytes]) -> str:
    """SHA-256 of the ids' names, joined by one space."""
    out = hashlib.sha256()
    for i in range(0, len(ids), 1 << 16):
        out.update((b" " if i else b"") + b" ".join(map(names.__getitem__, ids[i : i + (1 << 16)].tolist())))
    return out.hexdigest()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, unless
    ``digests_only``, ``ids`` and ``decoded``.  One row per input row: repeated and
    null ids stay, a null text is as an empty one (no ids, an empty decoding), an
    empty table gives no rows, other columns are ignored.  Texts of any length are
    whole: long ones go part by part, a few bytes of memory for each letter, and a
    word of any length takes time in proportion to it.  One pass, no shuffle.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not digests_only:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                texts, end, size = [], row, 0
                while end < batch.num_rows and (end == row or size <= GROUP_LETTERS):
                    texts.append(batch.column(1)[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                encoded = encoder.encode(texts)
                columns = [
                    batch.column(0).slice(row, end - row),
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([digest(x, encoder.decimals) for x in encoded]),
                    pa.array([digest(x, encoder.labels) for x in encoded]),
                ]
                if not digests_only:
                    columns += [pa.array(encoded, pa.list_(pa.int32())), pa.array([encoder.decode(x).decode() for x in encoded])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
                row = end

    return docs.select(id_col, text_col).mapInArrow(run, schema)
