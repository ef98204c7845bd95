"""Operator 13 against all windows, and its merge against a sort."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from panelspark.llm import suffix_dedup


def plain(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    times: dict[bytes, int] = {}
    for t in raw:
        for p in range(len(t) - length + 1):
            times[t[p : p + length]] = times.get(t[p : p + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            if times[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def letters(rnd: random.Random, n: int, some: str = "abcdefgh ") -> str:
    return "".join(rnd.choice(some) for _ in range(n))


def mixed(length: int) -> list[str | None]:
    """Copies, near copies, shared passages a byte longer or shorter than a window, runs of one letter, periods, odd letters."""
    rnd = random.Random(length)
    fresh = [letters(rnd, rnd.randint(length // 2, 6 * length)) for _ in range(12)]
    passage = letters(rnd, 3 * length)
    out: list[str | None] = [*fresh, fresh[0], fresh[0], fresh[1], None, "", "short", "short", "x" * (3 * length), "x" * (length - 1), "ab" * (2 * length), "É" * length, "É" * length]
    for n in (length - 1, length, length + 1, 2 * length, 3 * length):
        for _ in range(2):
            out.append(letters(rnd, rnd.randint(0, length)) + passage[-n:] + letters(rnd, rnd.randint(0, length)))
    for i in range(6):  # near copies: one letter differs here and there
        text = list(fresh[i % 3])
        for _ in range(3):
            text[rnd.randrange(len(text))] = "Z"
        out.append("".join(text))
    # left parts shared with one text, right parts with another
    a, b = letters(rnd, 2 * length), letters(rnd, 2 * length)
    out += [letters(rnd, length) + a[-length // 2 :] + b[: length // 2] + letters(rnd, length), a + b[: length // 4], a[-length // 4 :] + b, a[-3 * length // 4 :] + b[: length // 2]]
    return out


def found(spark, texts, length, **more):
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string, place int, spans string").repartition(4)
    rows = suffix_dedup.suffix_dedup(df, length=length, **more).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["kept"] == bytes(c for i, c in enumerate(raw) if not any(s["start"] <= i < s["stop"] for s in r["spans"]))
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("length", [20, 40, 120])
def test_equals_all_windows(spark, length):
    texts = mixed(length)
    assert found(spark, texts, length) == dict(enumerate(plain(texts, length)))


def test_hot_prefixes_and_segments_change_nothing(spark, monkeypatch):
    texts = mixed(60)
    want = dict(enumerate(plain(texts, 60)))
    assert found(spark, texts, 60, hot=1) == want
    text = pickled_segments(texts, 60)
    assert text == found(spark, texts, 60)


def pickled_segments(texts: list[str | None], length: int) -> dict:
    """The answer with all windows cut from small segments, without Spark."""
    shape = suffix_dedup.Shape(length)
    seen: dict[bytes, int] = {}
    windows = []
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        for at in range(0, len(raw), 97):
            part = raw[at : at + 97 + length - 1]
            cut = suffix_dedup.Slice(part, np.zeros(1, np.int64), np.array([len(part)]), shape)
            starts = sorted(p for low, high in zip(cut.low.tolist(), cut.high.tolist(), strict=True) for p in range(low, high + 1))
            assert starts == list(range(max(len(part) - length + 1, 0)))  # every window once
            for p in starts:
                window = part[p : p + length].tobytes()
                seen[window] = seen.get(window, 0) + 1
                windows.append((i, at + p, window))
    gone = {i: bytearray(len((t or "").encode())) for i, t in enumerate(texts)}
    for i, p, window in windows:
        if seen[window] > 1:
            gone[i][p : p + length] = b"\1" * length
    out = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        kept = bytes(c for c, g in zip(raw, gone[i], strict=True) if not g)
        spans = sum(g and not (j and gone[i][j - 1]) for j, g in enumerate(gone[i]))
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_equal_windows_have_equal_places():
    """Whatever surrounds a window, its sampled place lies at the same distance."""
    rnd = random.Random(3)
    shape = suffix_dedup.Shape(400)
    for _ in range(20):
        window = letters(rnd, 400)
        places = set()
        for _ in range(4):
            before = letters(rnd, rnd.randint(0, 500))
            data = np.frombuffer((before + window + letters(rnd, rnd.randint(0, 500))).encode(), np.uint8)
            cut = suffix_dedup.Slice(data, np.zeros(1, np.int64), np.array([len(data)]), shape)
            at = np.flatnonzero((cut.low <= len(before)) & (len(before) <= cut.high))
            assert len(at) == 1
            places.add(int(cut.x[at[0]]) - len(before))
        assert len(places) == 1


def test_loser_tree_merges_runs_and_knows_prefixes():
    rnd = random.Random(8)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(letters(rnd, rnd.randint(0, 9), "ab").encode() for _ in range(rnd.randint(1, 30))) for _ in range(k)]
        coded = [suffix_dedup.front_coded(r) for r in runs]
        order, prefix = suffix_dedup.merged([suffix_dedup.decoded(a.tolist(), b.tolist(), c) for a, b, c in coded])
        heads = [iter(r) for r in runs]
        got = [next(heads[r]) for r in order]
        assert got == sorted(x for r in runs for x in r)
        assert prefix == [len(os.path.commonprefix([a, b])) for a, b in zip([b"", *got], got, strict=False)]


def test_a_known_prefix_is_not_compared_again(monkeypatch):
    """Bytes compared in a merge grow with the texts' distinguishing bytes, not with their number of matches."""
    compared = 0
    real = suffix_dedup.common

    def counting(a, b, known):
        nonlocal compared
        n = real(a, b, known)
        compared += n - known
        return n

    monkeypatch.setattr(suffix_dedup, "common", counting)
    runs = [sorted(b"p" * 300 + bytes([i, j]) for j in range(100)) for i in range(8)]
    coded = [suffix_dedup.front_coded(r) for r in runs]
    compared = 0
    suffix_dedup.merged([suffix_dedup.decoded(a.tolist(), b.tolist(), c) for a, b, c in coded])
    assert compared < 300 * 8 + 800 * 4


def test_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).count() == 0
    assert found(spark, [None, "", "abc"], 400) == dict(enumerate(plain([None, "", "abc"], 400)))
