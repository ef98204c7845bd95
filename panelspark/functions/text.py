"""Text cleaning, tokens, sentiment and fingerprints."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Company names and the tickers they stand for.
ENTITIES = {
    "apple inc": "AAPL", "apple": "AAPL", "microsoft": "MSFT", "microsoft corp": "MSFT", "alphabet": "GOOGL", "google": "GOOGL", "amazon": "AMZN", "amazon.com": "AMZN",
    "meta platforms": "META", "facebook": "META", "nvidia": "NVDA", "nvidia corp": "NVDA", "tesla": "TSLA", "tesla inc": "TSLA", "jpmorgan": "JPM", "jp morgan": "JPM", "jpmorgan chase": "JPM",
    "bank of america": "BAC", "goldman sachs": "GS", "berkshire hathaway": "BRK", "johnson & johnson": "JNJ", "johnson and johnson": "JNJ", "procter & gamble": "PG", "procter and gamble": "PG",
    "walt disney": "DIS", "disney": "DIS", "coca-cola": "KO", "coca cola": "KO", "visa inc": "V", "mastercard": "MA", "federal reserve": "FED", "the fed": "FED",
    "securities and exchange commission": "SEC", "s&p 500": "SPX", "s&p500": "SPX", "sp500": "SPX", "nasdaq": "NDX", "dow jones": "DJI",
}
#: Patterns of money and of percentages.
MONEY = r"(?i)\$\s*(\d+(?:\.\d+)?)\s*(million|billion|trillion|mn|bn|tn|m|b|t)?"
PERCENT = r"(\d+(?:\.\d+)?)\s*(%|percent|pct|basis\s*points|bps)"
#: Entities of HTML, in the order in which they are decoded.
HTML_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Inc", "Corp", "Ltd", "Co", "Jr", "Sr", "vs", "etc", "vol", "no")
#: Patterns of script and style blocks, tags, links and mail addresses.
BLOCKS, TAGS, LINKS = r"(?is)<(script|style)[^>]*>.*?</\1>", r"<[^>]+>", (r"https?://\S+", r"www\.\S+")
MAIL = r"(?<!\S)\S+@\S+\.\S+"
#: White space as the splitting of fingerprints' words knows it.
WHITE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Words of the news lexicon.
POSITIVE = [
    "beat", "beats", "exceeded", "exceeds", "surpass", "outperform", "upgrade", "upgraded", "buy", "bullish", "growth", "profit", "revenue", "record", "high", "surge", "rally", "gain", "gains",
    "strong", "positive", "optimistic", "recovery", "improve", "expand", "expansion", "dividend", "buyback", "acquisition", "breakthrough", "innovation", "momentum", "accelerate",
]
NEGATIVE = [
    "miss", "missed", "decline", "declined", "fall", "fell", "drop", "downgrade", "downgraded", "sell", "bearish", "loss", "losses", "weak", "negative", "pessimistic", "recession", "layoff",
    "restructuring", "warning", "risk", "concern", "debt", "default", "bankruptcy", "fraud", "investigation", "lawsuit", "crash", "plunge", "tumble", "slump", "deteriorate",
]
INTENSE = ["significantly", "dramatically", "sharply", "record", "unprecedented", "massive", "huge", "enormous"]
#: Words of the baseline lexicon.
BASE_POSITIVE = ["gain", "gains", "beat", "beats", "surge", "surged", "profit", "profits", "growth", "upgrade", "upgraded", "strong", "record", "rally", "outperform"]
BASE_NEGATIVE = ["loss", "losses", "miss", "missed", "plunge", "plunged", "decline", "declined", "downgrade", "downgraded", "weak", "lawsuit", "probe", "fraud", "underperform"]


def held(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), for which x is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(x), use), 1)


def replaced_where(x: Column, sign: str, pattern: str, new: str) -> Column:
    """Matches of a pattern that all hold ``sign`` replaced; texts without it are not searched."""
    return held(x, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, new)).otherwise(t))


def strip_html(x: Column) -> Column:
    """Without script and style blocks; tags become spaces, entities their characters."""
    x = held(x, lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(F.regexp_replace(t, BLOCKS, ""), TAGS, " ")).otherwise(t))
    for name, char in HTML_ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


@F.pandas_udf(T.StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    keep = set("€£¥°±×÷")
    return x.map(lambda t: None if t is None else t if t.isascii() else "".join(c if ord(c) < 128 or c in keep else " " for c in unicodedata.normalize("NFKD", t)))


def ascii_folded(x: Column) -> Column:
    """Compatibility decomposition; what is not ASCII becomes a space, but for a few signs."""
    return _decomposed(x)


def mark_links(x: Column) -> Column:
    for pattern, sign in zip(LINKS, ("://", "www."), strict=True):
        x = replaced_where(x, sign, pattern, " <URL> ")
    return replaced_where(x, "@", MAIL, " <EMAIL> ")


def mark_entities(x: Column, entities: dict[str, str] = ENTITIES) -> Column:
    return mark_names(replaced_where(x, "$", r"\$([A-Z]{1,5})\b", "<TICKER_$1>"), entities)


def mark_names(x: Column, entities: dict[str, str]) -> Column:
    """Whole names in any case become their tickers, the longest first; only the names that stand somewhere in a text are looked for by their patterns."""
    names = sorted(entities, key=len, reverse=True)
    if not names:
        return x
    inside = lambda n: "<" in n or ">" in n or n.lower().startswith("ticker_")  # noqa: E731  a ticker put in before may make such a name
    steps = F.array(*[F.struct(F.lit("" if inside(n) else n.lower()).alias("name"), F.lit(rf"(?i)\b\Q{n}\E\b").alias("pattern"), F.lit(f"<TICKER_{entities[n]}>").alias("ticker")) for n in names])
    found = lambda t, low: F.aggregate(F.filter(steps, lambda s: F.contains(low, s["name"])), t, lambda done, s: F.regexp_replace(done, s["pattern"], s["ticker"]))
    return held(x, lambda t: held(F.lower(t), lambda low: found(t, low)))


def mark_numbers(x: Column) -> Column:
    x = F.regexp_replace(replaced_where(x, "$", MONEY, " <MONEY> "), PERCENT, " <PERCENT> ")
    return F.regexp_replace(x, r"\b\d{6,}\b", " <BIGNUM> ")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "))


def clean(x: Column, most: int = 2560, entities: dict[str, str] = ENTITIES) -> Column:
    """The whole cleaning of a text: markup, letters, links, names, numbers, white space, length."""
    return F.substring(collapse(mark_numbers(mark_entities(mark_links(ascii_folded(strip_html(x))), entities))), 1, most)


def sentences(x: Column) -> Column:
    """Split after . ! or ? and white space, abbreviations protected; sentences of over 10 characters."""
    x = F.regexp_replace(x, rf"({'|'.join(ABBREVIATIONS)})\.", "$1<DOT>")
    parts = F.split(x, r"(?<=[.!?])[ \t\n\r\f\x0B]+")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(F.replace(s, F.lit("<DOT>"), F.lit(".")), r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""))
    return F.filter(trimmed, lambda s: F.length(s) > 10)


def tokens(x: Column) -> Column:
    """Lower case, without links, of a-z, 0-9 and . , - % $ only, runs of digits apart."""
    x = F.regexp_replace(F.lower(x), r"https?://\S+", "")
    x = F.regexp_replace(x, r"[^a-z0-9\s.,\-%$]", "")
    x = F.regexp_replace(x, r"([0-9]+)", " $1 ")
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def counted(words: Column, names: list[str]) -> Column:
    return F.size(F.filter(words, lambda t: t.isin(names)))


def lexicon(x: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, intense: list[str] = INTENSE) -> dict[str, Column]:
    """Score, label and confidence by counts of the lexicon's words among the lower-cased, space-separated ones."""
    words = F.split(F.lower(x), r"\s+")
    pos, neg, strong = (counted(words, names) for names in (positive, negative, intense))
    total = pos + neg
    raw = (pos - neg) / F.nullif(total, F.lit(0)) * (1 + 0.2 * F.least(strong, F.lit(3)))
    score = F.coalesce(F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))
    return {
        "score": score,
        "label": F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral"),
        "confidence": F.when(total == 0, 0.3).otherwise(F.least(0.4 + 0.1 * total, F.lit(0.85))),
    }


def net_tone(x: Column, positive: list[str] = BASE_POSITIVE, negative: list[str] = BASE_NEGATIVE) -> Column:
    """(positive - negative) / words, commas and periods as spaces; 0 without words."""
    words = F.filter(F.split(F.lower(F.translate(x, ",.", "  ")), r"\s+"), lambda t: t != "")
    return F.coalesce((counted(words, positive) - counted(words, negative)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def day_text(x: Column, order: Column) -> Column:
    """An aggregate: the texts of a group in order, joined by a period between spaces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("t")))), lambda s: s["t"]), " . ")


def vocabulary(words: DataFrame, col: str, least: int, most: int) -> DataFrame:
    """(token, n, id) of the ``most`` - 4 most frequent tokens; ids from 4, ties by the token."""
    counts = words.select(F.explode(col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(most - 4)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3)


def encode(words: Column, table: dict[str, int], length: int) -> Column:
    """Begin (2), ids (1: unknown) and end (3), cut or padded (0) to ``length``; padding alone without words."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    ids = F.transform(F.slice(words, 1, length - 2), lambda t: F.coalesce(known[t], F.lit(1)))
    full = F.concat(F.array(F.lit(2)), ids, F.array(F.lit(3)))
    empty = F.array_repeat(F.lit(0), length)
    return F.when(F.size(words) == 0, empty).otherwise(F.slice(F.concat(full, empty), 1, length))


def fnv1a(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit FNV-1a of each data[start:end], byte by byte for all of them at once."""
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(starts - ends, kind="stable")  # the longest first: those that have an n-th byte are in front
    sizes = (ends - starts)[order]
    for n in range(int(sizes.max(initial=0))):
        some = order[: int(np.searchsorted(-sizes, -n, side="left"))]
        h[some] = (h[some] ^ data[starts[some] + n]) * np.uint64(0x100000001B3)
    return h


def print_words(x: Column) -> Column:
    """Words that vote for a fingerprint: lower case, split at white space."""
    return F.filter(F.split(F.lower(x), WHITE), lambda t: t != "")


#: Words whose hashes are in memory at once, but for a longer text.
VOTERS = 1 << 18


@F.arrow_udf(T.LongType())
def simhash(words: pa.Array) -> pa.Array:
    """64-bit fingerprint: every word votes with the bits of its hash; 0 without words.  A batch is taken in parts of so many words; each distinct one of a part is hashed once."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, row = [np.zeros(0, np.int64)], 0
    while row < len(ends):
        before = ends[row - 1] if row else 0
        end = max(int(np.searchsorted(ends, before + VOTERS, side="right")), row + 1)
        out.append(_voted(words.slice(row, end - row)))
        row = end
    return pa.array(np.concatenate(out))


def _voted(words: pa.Array) -> np.ndarray:
    lists = words.cast(pa.large_list(pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    distinct = flat.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8).astype(np.uint64)
    bits = np.unpackbits(fnv1a(data, offsets[:-1], offsets[1:]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    index = flat.indices.to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out, at = np.zeros(len(sizes), np.int64), 0
    for row, n in enumerate(sizes.tolist()):
        if n:
            ones = bits[index[at : at + n]].sum(axis=0)
            out[row] = np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]
        at += n
    return out


def near_fingerprints(prints: DataFrame, print_col: str, most: int = 3) -> DataFrame:
    """(a, b), a < b by ``n``, of distinct fingerprints (print_col, n) that differ in at most ``most`` bits.

    Cut into most + 3 fields, two such fingerprints agree in three fields at least, so
    they meet under one of the choices of three: keys of half the bits, which hardly
    any other fingerprints share.  The rows of all choices, twenty a fingerprint, are
    merged: a small file of fingerprints would else be broadcast with all of them.
    """
    fields = most + 3
    edges = [64 * i // fields for i in range(fields + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i]) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(fields)]  # as signed longs
    part = lambda i: F.shiftrightunsigned(F.col(print_col), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    choices = list(combinations(range(fields), 3))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(*(part(i) for i in some)).alias("v")) for k, some in enumerate(choices)])
    rows = prints.select("n", print_col, F.explode(keys).alias("key"))
    a, b = (rows.select(F.col("n").alias(x), F.col(print_col).alias(f"f{x}"), "key") for x in ("a", "b"))
    both = F.col("fa").bitwiseXOR(F.col("fb"))
    # a pair counts under the first three fields in which it agrees, so that it is found once
    agree = F.array_compact(F.array(*[F.when(both.bitwiseAND(F.lit(field)) == 0, F.lit(i)) for i, field in enumerate(masks)]))
    here = F.element_at(F.array(*[F.array(*map(F.lit, some)) for some in choices]), F.col("key.k") + 1)
    return a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(both) <= most) & (F.slice(agree, 1, 3) == here)).select("a", "b")


def keep_first(df: DataFrame, key: str, print_col: str, store: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """(key, kept): greedy removal in the order of ``key``; a row goes if a kept row before it is within ``most`` bits.

    Rows of one fingerprint share the fate of their first one, which the others
    then duplicate.  Among distinct fingerprints a round lets go all rows that are near
    a row with no near row left before it; only pairs of undecided rows are read again.
    There are as many rounds as the longest chain of such dependences has rows.  Tables
    of rows are merged, never broadcast.  ``store`` writes a table and reads it.
    """
    first = store(df.groupBy(F.col(print_col).alias("_print")).agg(F.min(key).alias("n")))
    near = store(near_fingerprints(first, "_print", most))
    gone = []
    while not near.isEmpty():
        later = near.select(F.col("b").alias("a")).distinct()
        gone.append(store(near.join(later.hint("merge"), "a", "left_anti").select(F.col("b").alias("n")).distinct()))
        for side in ("b", "a"):
            near = near.join(gone[-1].withColumnRenamed("n", side).hint("merge"), side, "left_anti")
        near = store(near.select("a", "b"))
    stays = first.join(reduce(DataFrame.unionByName, gone).hint("merge"), "n", "left_anti") if gone else first
    stays = stays.select(F.col("n").alias(key), "_print", F.lit(True).alias("_stays"))
    return df.select(key, F.col(print_col).alias("_print")).join(stays.hint("merge"), [key, "_print"], "left").select(key, F.coalesce("_stays", F.lit(False)).alias("kept"))
