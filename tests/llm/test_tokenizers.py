from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from panelspark.llm import arrays, bpe_automaton, packing, rank_merge, token_store
from panelspark.llm.arrays import HashMap, hash_spans, text_chunks
from panelspark.llm.shared import shared_folder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = ["a", "b", "'", "s", "'s", "'re", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "é", "É", "1", "23", "²", "!", "?!", "中", "　", "\xa0", "́", "'ll", "'LL", "🎉", "\x85", "\x1c", "Σ", "İ", "ing", "tion"]


def mixed(n: int) -> list[str]:
    rnd = random.Random(3)
    out = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]
    return [*out, *("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 14))) for _ in range(n)), "a" * 500, "ab" * 300, "", " ", "'"]


def library(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_automaton_matches_library():
    texts = mixed(1500)
    encoder = bpe_automaton.WordEncoder(WORD, cache_bits=8)
    tokenizer = Tokenizer.from_file(WORD)
    found = encoder.encode(texts)
    mine = [x.tolist() for x in found]
    assert mine == library(WORD, texts)
    assert [encoder.decode(x).decode() for x in found] == [tokenizer.decode(x, skip_special_tokens=False) for x in mine]


def test_rank_merge_matches_library():
    texts = mixed(1500)
    encoder = rank_merge.RankEncoder(BYTE, ids=True, cache_bits=8)
    counter = rank_merge.RankEncoder(BYTE, ids=False, cache_bits=8)
    found, counts = [], []
    for _, data, offsets in text_chunks(pa.array(texts), 4096):
        ids, n = encoder.encode(data, offsets)
        cuts = np.concatenate([[0], np.cumsum(n)])
        found += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        counts += counter.count(data, offsets).tolist()
    assert found == library(BYTE, texts)
    assert counts == [len(x) for x in found]


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def alike() -> list[str]:
    """Words whose polynomial hashes modulo a power of two meet, and words that share long heads and tails."""
    words = [thue_morse(n, *x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]
    words += ["z" * 40 + c + "z" * 40 for c in "pq"] + ["y" * n for n in (31, 32, 33, 34)] + ["ab\x00", "ab"]
    return words + words[::-1]


def test_words_that_hash_alike():
    hashes = [hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in set(alike())]
    assert len(set(hashes)) == len(set(alike()))
    texts = [*alike(), " ".join(alike())]
    assert [x.tolist() for x in bpe_automaton.WordEncoder(WORD).encode(texts)] == library(WORD, texts)
    for encoder in (rank_merge.RankEncoder(BYTE, ids=True), token_store.LibraryEncoder(BYTE)):
        found = [encoder.encode(data, offsets)[0].tolist() for t in texts for _, data, offsets in text_chunks(pa.array([t]))]
        assert found == library(BYTE, texts)


def test_caches_compare_bytes(monkeypatch):
    """Words stay apart even if all have one hash."""
    monkeypatch.setattr(arrays, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = mixed(60)
    assert [x.tolist() for x in bpe_automaton.WordEncoder(WORD).encode(texts)] == library(WORD, texts)
    for encoder in (rank_merge.RankEncoder(BYTE, ids=True), token_store.LibraryEncoder(BYTE)):
        found = []
        for _, data, offsets in text_chunks(pa.array(texts), 512):
            ids, n = encoder.encode(data, offsets)
            found += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert found == library(BYTE, texts)


def test_long_words_and_texts(monkeypatch):
    rnd = random.Random(12)
    word = "".join(rnd.choice("etaoinshr") for _ in range(300_000))
    start = time.perf_counter()
    assert bpe_automaton.WordEncoder(WORD).encode([word])[0].tolist() == library(WORD, [word])[0]
    assert time.perf_counter() - start < 20
    # parts of long texts
    monkeypatch.setattr(rank_merge, "PART_BYTES", 200)
    monkeypatch.setattr(bpe_automaton, "GROUP_LETTERS", 200)
    texts = [" ".join(mixed(200)), "\n\n".join("it's " * rnd.randint(1, 9) for _ in range(300)), "x" * 5000, " " * 5000]
    assert [x.tolist() for x in bpe_automaton.WordEncoder(WORD).encode(texts)] == library(WORD, texts)
    wanted = library(BYTE, texts)
    encoder, counter = token_store.LibraryEncoder(BYTE), rank_merge.RankEncoder(BYTE, ids=False)
    for t, ids in zip(texts, wanted, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == ids
        assert counter.count(data, np.array([0, len(data)])).tolist() == [len(ids)]


def test_hash_map_with_collisions():
    keys = np.arange(1, 3000, dtype=np.uint64) << np.uint64(50)
    table = HashMap(keys, np.arange(len(keys)))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(np.array([0, 7], np.uint64)) == -1).all()


def test_encode_decode_query(docs, nothing, texts):
    rows = bpe_automaton.encode_decode(docs, WORD).collect()
    ids = library(WORD, [t or "" for _, t in texts])
    tokenizer = Tokenizer.from_file(WORD)
    wanted = Counter((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(texts, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == wanted
    assert bpe_automaton.encode_decode(nothing, WORD).count() == 0


def test_token_counts_query(docs, nothing, texts):
    wanted = Counter((i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(texts, library(BYTE, [t or "" for _, t in texts]), strict=True))
    assert Counter(map(tuple, rank_merge.token_counts(docs, BYTE).collect())) == wanted
    assert rank_merge.token_counts(nothing, BYTE).count() == 0


def test_token_store_round_trip(spark, docs, texts):
    folder = shared_folder(spark, "store-test")
    token_store.write_store(docs, folder, BYTE)
    rows = token_store.read_store(spark, folder).orderBy("start").collect()
    wanted = {}
    for (i, _), x in zip(texts, library(BYTE, [t or "" for _, t in texts]), strict=True):
        wanted.setdefault(i, []).append([*x, 2])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert list(r.ids) in wanted[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert token_store.fetch(spark, folder, 101) == wanted[101]
    assert sorted(token_store.fetch(spark, folder, 5)) == sorted(wanted[5])


def test_token_store_of_nothing(spark, nothing):
    folder = shared_folder(spark, "store-empty")
    token_store.write_store(nothing, folder, BYTE)
    assert token_store.read_store(spark, folder).count() == 0


def test_store_rejects_another_dictionary(spark, docs):
    folder = shared_folder(spark, "store-bad")
    token_store.write_store(docs, folder, BYTE)
    spark.createDataFrame([("0" * 64, 2, bytearray(b"x" * 64))], "dict_hash string, width int, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        token_store.load_dictionary(spark, folder)


def test_packing(docs, nothing, texts):
    rows = packing.pack(docs, BYTE, capacity=128).collect()
    wanted = Counter()
    for (i, _), x in zip(texts, library(BYTE, [t or "" for _, t in texts]), strict=True):
        x, at, piece = [*x, 2], 0, 0
        while at < len(x):
            size = (len(x) % 128 or 128) if piece == 0 else 128
            wanted[i, piece, at, size, zlib.crc32(np.array(x[at : at + size], "<u4").tobytes())] += 1
            at, piece = at + size, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * -(-total // 128) + 1
    assert packing.pack(nothing, BYTE).count() == 0


@pytest.mark.parametrize("base", [1 << 17, 100, 7])
def test_plan_places_everything(base):
    rng = np.random.default_rng(4)
    histogram = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    plan = packing.make_plan(histogram, 64, base)
    used: dict = {}
    for length in range(1, 65):
        slots = slice(plan.first[length], plan.first[length + 1])
        begin, sequence, offset = plan.begin[slots], plan.sequence[slots], plan.offset[slots]
        for rank in range(histogram[length]):
            k = int(np.searchsorted(begin, rank, side="right")) - 1
            used.setdefault(int(sequence[k] + rank - begin[k]), []).append((int(offset[k]), length))
    for places in used.values():
        at = 0
        for o, length in sorted(places):
            assert o == at
            at += length
        assert at <= 64
    assert len(used) == plan.sequences


def test_shards_keep_near_the_bound():
    """Half a million pieces over several shards take hardly more sequences than their tokens fill."""
    rng = np.random.default_rng(16)
    sizes = np.clip(rng.lognormal(5.3, 0.9, 500_000).astype(np.int64), 1, 1024)
    histogram = np.bincount(sizes, minlength=1025)
    plan = packing.make_plan(histogram, 1024)
    assert plan.sequences <= 1.002 * -(-int(sizes.sum()) // 1024)


def test_sum_of_squares_rule():
    """Each place has the smallest sum of squares of all that were to be had."""
    rng = np.random.default_rng(1)
    items = rng.integers(1, 17, 200)
    where, offset, _ = packing.place_all(items, 16)
    gaps: dict[int, int] = {}
    for s, seq in zip(items.tolist(), where.tolist(), strict=True):
        def cost(changed):
            count = Counter(g for g in changed.values() if 0 < g < 16)
            return sum(n * n for n in count.values())

        options = [cost({**gaps, q: g - s}) for q, g in gaps.items() if g >= s] + [cost({**gaps, seq if seq not in gaps else -1: 16 - s})]
        gaps[seq] = gaps.get(seq, 16) - s
        assert gaps[seq] >= 0 and cost(gaps) == min(options)
