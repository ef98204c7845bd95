from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, n_words string, key string, lines_total int"
#: Names that operators use inside, of types that are not theirs.
INSIDE = ("_key", "_blocks", "_id", "_text", "id", "blocks", "total", "root", "name", "TEXT_KEY")
SCHEMA += "".join(f", {c} string" for c in INSIDE)
CLASH = ("clash", "clash", 1, *(f"kept {c}" for c in INSIDE))


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): nulls, empty, short and very long texts, ties, copies, near copies, shared passages, odd characters."""
    rnd = random.Random(7)
    base = [sentence(rnd, rnd.randint(5, 80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = sentence(rnd, 60)
    for i in range(40, 60):
        rows.append((i, sentence(rnd, 30) + "\n" + passage + "\n" + sentence(rnd, 10)))
    for i in range(60, 90):  # near copies of few documents
        words = base[i % 5].split(" ")
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(90, base[0]), (91, base[0]), (92, None), (93, ""), (94, " \n\t "), (95, "one"), (96, "One"), (97, "a b c d e f"), (98, "a b c d e f g")]
    rows += [(99, "É " * 30), (100, "x" * 5000), (101, sentence(rnd, 6000)), (102, "it's <|endoftext|>THE 12 end<|startoftext|>"), (103, "Released under the MIT License. And the mit license, Apache License too.")]
    rows += [(104, "#tag #tag | a & b\n#tag #tag | a & b\n\n\nx"), (None, "no id at all but some words here to read"), (5, base[5]), (5, base[5]), (105, "\n".join([base[1], base[2], base[3]]))]
    rows += [(106, "\n".join([base[1], "new words between them", base[3]]))]
    rows += [(200 + i, " ".join(c)) for i, c in enumerate([("a", "b", "c", "d", "e", "f", "g", "h"), ("a", "b", "c", "d", "e", "f", "g", "h", "i"), ("p", "q"), ("P", "q")])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with extra columns whose names operators use inside."""
    rows = [(i, t, *CLASH) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
