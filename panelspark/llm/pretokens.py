"""Pre-tokenization by arrays: where the words of the public BPE files begin and end."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
#: The contractions of the published pattern, after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the regex library."""
    out = np.zeros(0x110000, dtype=np.uint8)
    plain = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, plain):
            a, b = m.span()
            for low, high, shift in ((0, 0xD800, 0), (0xD800, 0x110000 - 0x800, 0x800)):
                x, y = max(a, low), min(b, high)
                if x < y:
                    out[x + shift : y + shift] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lead bytes and the code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, first = lead[wide], b[wide]
        c1, c2, c3 = (padded[at + j].astype(np.uint32) & 0x3F for j in (1, 2, 3))
        two = ((first & 0x1F) << 6) | c1
        three = ((first & 0x0F) << 12) | (c1 << 6) | c2
        four = ((first & 0x07) << 18) | (c1 << 12) | (c2 << 6) | c3
        b[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return lead, b


def contractions(points: np.ndarray, kind: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the contraction's letters after an apostrophe at each ``at``; 0 if none. ends: where its text ends."""
    n = len(points)
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    size = np.zeros(len(at), dtype=np.int64)
    for word in reversed(CONTRACTIONS):
        hit = at + len(word) < ends
        for j, c in enumerate(word):
            hit &= padded[np.minimum(at + 1 + j, n + 1)] == ord(c)
        size[hit] = len(word)
    return size


def split_words(data: np.ndarray, offsets: np.ndarray, byte_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of each text data[offsets[i]:offsets[i+1]].

    byte_level: the published byte-level pattern, in which a space belongs to the
    word after it and nothing is dropped.  Otherwise white space is dropped and
    each digit stands alone.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lead, points = code_points(data)
    n = len(points)
    kind = classes()[points]
    text = np.searchsorted(lead, offsets)  # code point offsets of the texts
    begins = np.zeros(n + 1, dtype=bool)
    begins[text] = True
    run = begins[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    start = run.copy()
    quote = np.flatnonzero(run & (points == 39))
    next_run = np.zeros(n + 1, dtype=bool)
    next_run[:n] = run
    next_run[n] = True
    quote = quote[next_run[quote + 1]]  # runs of one apostrophe
    if byte_level:
        # the last white space before a word: a plain space joins it, another one stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & run[1:] & ~begins[1:n])
        start[last] = True
        joined = last[points[last] == 32]
        start[joined + 1] = False
        if len(quote):
            quote = quote[start[quote]]
    if len(quote):
        ends = text[np.searchsorted(text, quote, side="right")]
        size = contractions(points, kind, quote, ends)
        at, size = quote[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        ok = after < n
        start[after[ok]] = True
    if not byte_level:
        start |= kind == DIGIT
    first = np.flatnonzero(start)
    lead = np.append(lead, len(data))
    starts = lead[first]
    ends = lead[np.append(first[1:], n)]
    if not byte_level:
        keep = kind[first] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def cut_at(data: bytes, offsets: np.ndarray, marks: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts at special strings: new offsets, the text of each piece, the special id of each piece (-1: ordinary)."""
    found = []
    if data.find(b"<|") >= 0:
        pattern = regex.compile(b"|".join(regex.escape(k.encode()) for k in marks))
        for m in pattern.finditer(data):
            i = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            if m.end() <= offsets[i + 1]:
                found.append((m.start(), m.end(), i, marks[m.group().decode()]))
    n = len(offsets) - 1
    if not found:
        return offsets, np.arange(n), np.full(n, -1)
    cuts = np.unique(np.concatenate([offsets, [x for f in found for x in f[:2]]]))
    bounds, text, special = [], [], []
    inside = {f[0]: f for f in found}
    # empty texts vanish from the cuts; they hold no tokens
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        bounds.append(a)
        text.append(int(np.searchsorted(offsets, a, side="right")) - 1)
        special.append(inside[a][3] if a in inside else -1)
    return np.array([*bounds, int(cuts[-1])]), np.array(text), np.array(special)


def safe_cuts(data: np.ndarray, size: int) -> list[tuple[int, int]]:
    """[start, end) of parts of about ``size`` bytes that can be split into words one by one.

    A cut is made between an ASCII letter and a blank after it: there a word ends
    in either kind of file, no special string holds a blank, and neither
    composition nor lower case looks over it.  Without such a place a part is longer.
    """
    out, at = [], 0
    while at < len(data):
        end = len(data)
        low = at + size
        while low < len(data):
            window = data[low - 1 : low + size]
            after = window[1:]
            letter = ((window[:-1] | 0x20) >= 97) & ((window[:-1] | 0x20) <= 122)
            cut = np.flatnonzero(letter & ((after == 32) | (after == 10)))
            if len(cut):
                end = low + int(cut[0])
                break
            low += size
        out.append((at, end))
        at = end
    return out
