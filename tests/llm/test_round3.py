"""Operators 11 and 12 against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from panelspark.llm import conversation_repair, vector_codes


def plain_codes(rows, parts=4, entries=256, scale=1024, rounds=4):
    """(id, code, error) and codebooks of (id, vector) rows, by whole sums in each round."""
    kept = sorted((i, [math.floor(scale * Fraction(v)) for v in x]) for i, x in rows)
    length = len(kept[0][1])
    cut = [length * k // parts for k in range(parts + 1)]
    part = lambda x, k: x[cut[k] : cut[k + 1]]
    books = [[part(x, k) for _, x in kept[:entries]] for k in range(parts)]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    best = lambda x, k: min((distance(part(x, k), c), n) for n, c in enumerate(books[k]))
    for _ in range(rounds):
        taken = [[best(x, k)[1] for _, x in kept] for k in range(parts)]
        for k in range(parts):
            for entry in range(len(books[k])):
                own = [part(x, k) for (_, x), n in zip(kept, taken[k], strict=True) if n == entry]
                if own:
                    books[k][entry] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, x in kept:
        found = [best(x, k) for k in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return sorted(out), books


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, x string, id int").repartition(3)


def test_codes_equal_plain_rounds(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((-1, 1)) * rnd.randint(0, 4096) / 1024 / 8 for _ in range(8)]) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1])]
    extra = [(7, None), (8, [1.0, None] + [0.0] * 6), (9, [float("nan")] + [0.0] * 7), (10, [float("-inf")] + [0.0] * 7)]
    df = vectors(spark, [(i, x, None if i % 3 else i % 2, "clash", "clash", 0) for i, x in rows + extra])
    for entries in (16, 256):
        found = vector_codes.compress(df, entries=entries)
        want, books = plain_codes(rows, entries=entries)
        assert sorted((r["id"], r["code"], r["error"]) for r in found.codes.collect()) == want
        assert [b.tolist() for b in found.codebooks] == books
        text = ",".join(str(v) for b in books for e in b for v in e)
        assert found.digest() == hashlib.sha256(text.encode()).hexdigest()
        sums = {}
        labels = {i: None if i % 3 else i % 2 for i, _ in rows}
        for i, _, e in want:
            sums[labels[i]] = sums.get(labels[i], 0) + e
        assert {(r["id"], r["label_error"]) for r in vector_codes.label_errors(found.codes).collect()} == {(i, sums[labels[i]]) for i in labels}


def test_codes_of_huge_components_other_lengths_and_nothing(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice((0, 8, 300)) for _ in range(5)]) for i in range(12)]
    rows.append((12, [1.7e308, -1.7e308, 0.0, 0.0, 1.0]))
    found = vector_codes.compress(vectors(spark, [(i, x, 1, "", "", 0) for i, x in rows] + [(90, [1.0], 1, "", "", 0), (None, rows[0][1], 1, "", "", 0)], "double"), entries=3)
    want, books = plain_codes([*rows, (99, rows[0][1])], entries=3)
    got = {r["id"]: (r["code"], r["error"]) for r in found.codes.collect()}
    assert got.pop(90) == (None, None)
    assert got == {None if i == 99 else i: (c, e if e < 1 << 63 else None) for i, c, e in want}
    assert [b.tolist() for b in found.codebooks] == books
    assert vector_codes.label_errors(found.codes).where("label_error IS NULL").count() == 15
    nothing = vector_codes.compress(vectors(spark, [(1, None, 1, "", "", 0)]))
    assert vector_codes.label_errors(nothing.codes).count() == 0 and nothing.digest() == hashlib.sha256(b"").hexdigest()


def cheapest(kinds):
    """(cost, audit) of the cheapest edits, by search over all of them; kinds: (initial, must go, cut off)."""
    best = None

    def go(i, state, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(kinds) and state in "-a":
            best = min(best, (cost, audit)) if best else (cost, audit)
        following = {"-": "u", "s": "u", "u": "a", "a": "u"}[state]
        if cost <= 3 * len(kinds):
            go(i, following, cost + 2, audit + "I")
        if i == len(kinds):
            return
        initial, gone, cut = kinds[i]
        go(i + 1, state, cost + 3, audit + "D")
        if not gone:
            go(i + 1, following, cost + 2 + cut, audit + "R")
            if (initial == "s" and state == "-") or initial == following:
                go(i + 1, initial, cost + cut, audit + "K")

    go(0, "-", 0, "")
    return best


BLANK = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """The contract's row of one conversation, given its rows (conv_id, turn, role, text)."""
    after = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in after:
        said = text.rstrip(BLANK)
        fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        kinds.append((role[:1], fault in (1, 2), int(fault == 3)))
    turns = [t for t, _, _ in after if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    cost, audit = cheapest(kinds)
    lines, i, state = [], 0, "-"
    for letter in audit:
        following = {"-": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if letter == "I":
            lines.append(following + ":")
            state = following[0]
            continue
        _, role, text = after[i]
        i += 1
        if letter != "D":
            role = role if letter == "K" else following
            lines.append(f"{role}:{text}")
            state = role[0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rnd = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 6)):
            rows.append((conv, rnd.choice((turn, turn, turn, turn + 3, None)), rnd.choice(("user", "assistant", "system", "assistant", "user", "tool", "", None)), rnd.choice(("Yes.", "No!", "so what", " \n", "", None, "Well?\n", "É.", f"Number {turn}. "))))
    return rows + [(70, 0, "user", "Hi.")] * 3 + [(71, 5, "assistant", "x" * 100_000 + ".")]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_equals_search_over_all_edits(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, conv int").repartition(4)
    turns = conversation_repair.damaged(df)
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in conversation_repair.repair(turns).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == plain_repair([r for r in rows if r[0] == conv]), conv
    told = conversation_repair.repaired_turns(turns).orderBy("conv", "place").collect()
    for conv, row in got.items():
        lines = [f"{r['role']}:{r['text']}" for r in told if r["conv"] == conv]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row[-1]


def test_repair_goes_on_over_batches(spark):
    """A conversation far longer than a batch."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"Turn {t % 700}{'.' if t % 5 else ''}") for t in range(3000)] + [(2, 0, "system", "Be nice.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    at_once = conversation_repair.repair(conversation_repair.damaged(df)).orderBy("conv").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        pieces = conversation_repair.repair(conversation_repair.damaged(df)).orderBy("conv").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert at_once == pieces and len(at_once) == 2
    assert at_once[0]["duplicate"] > 1900 and at_once[1]["audit"] == "D"


def test_repair_of_nothing(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(conversation_repair.damaged(nothing)).count() == 0
    assert conversation_repair.repaired_turns(conversation_repair.turns_of(nothing)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(5, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    row = conversation_repair.repair(conversation_repair.damaged(one)).first()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.turns_of(one).where(F.col("present")).count() == 1
