from __future__ import annotations

import difflib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import jaccard_join, language_model, license_scan, line_dedup, quality

from .conftest import INSIDE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def figures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((i, *figures(t)) for i, t in texts)
    assert all(r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD) for r in rows)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.quality_rules(nothing, labels).count() == 0
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.log_ratio == 0 for r in none)


def plain_ratio(rows: list[tuple], trusted: set) -> dict:
    """Lowest windows' log ratios from counts of words and pairs as they are, without buckets."""
    raw, target = Counter(), Counter()
    grams = {i: [*WORD.findall(t or ""), *zip(WORD.findall(t or ""), WORD.findall(t or "")[1:], strict=False)] for i, t in rows}
    for i, found in grams.items():
        raw.update(found)
        target.update(found if i in trusted else [])
    share = sum(target.values()) / sum(raw.values())

    def weight(g):
        expected, ratio = raw[g] * share, math.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR))
        return ratio if abs(ratio) >= quality.LEAST_RATIO and abs(target[g] - expected) >= quality.DEVIATIONS * math.sqrt(expected + 1) else 0.0

    out = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        score = [weight(w) + (weight((w, words[j + 1])) if j + 1 < len(words) else 0) for j, w in enumerate(words)]
        n = min(len(words), quality.WINDOW_WORDS)
        out[i] = min((sum(score[j : j + n]) / n for j in range(len(words) - n + 1)), default=0.0) if n else 0.0
    return out


def test_ratio_against_plain_counts(spark):
    rnd = random.Random(14)
    clean = [(i, " ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "and", "looked", "at", "dogs"]) + str(rnd.randint(0, 4)) for _ in range(rnd.randint(12, 90)))) for i in range(300)]
    bad = []
    for i in range(60):  # among clean words, one bad one in fifteen
        words = [x for _, t in clean[i : i + 2] for x in t.split()]
        for j in range(0, len(words), 15):
            words[j] = rnd.choice(["vile1", "vile2"])
        bad.append((1000 + i, " ".join(words)))
    rows = [*clean, *bad, (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 1, 1), (1001, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    wanted = plain_ratio(rows, set(range(200)))
    assert all(math.isclose(found[i].log_ratio, x, rel_tol=1e-6, abs_tol=1e-9) for i, x in wanted.items())
    assert all(found[i].kept == (not found[i].base_failed) for i, _ in clean) and not any(found[i].kept for i, _ in bad)


def test_trusted_ids_beside_nulls(spark):
    """Ids over 2**53 keep their own last digits where a batch holds a null id."""
    big = 1 << 60
    docs = spark.createDataFrame([(None, "a b c"), (big, "d e f"), (big + 1, "g h i")], "doc_id long, text string").coalesce(1)
    rows = quality.gram_counts(docs, np.array([big]), "doc_id", "text").agg({"target": "sum"}).first()
    assert rows[0] == 5


def shingle_sets(texts) -> list[frozenset]:
    out = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(texts, sets) -> list:
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(texts[i][0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [low[find(i)] for i in range(len(texts))]


def test_jaccard_join(docs, nothing, texts):
    sets = shingle_sets(texts)
    wanted = Counter((i, len(s), c) for (i, _), s, c in zip(texts, sets, brute_components(texts, sets), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()) == wanted
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_jaccard_join_of_dense_groups(spark, monkeypatch):
    """Near copies of one document that link with some others only, small sets, and lists over HEAVY."""
    import random

    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    rnd = random.Random(11)
    rows = []
    for size in (6, 7, 9, 11, 14, 20, 40, 90):
        base = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(k) for k in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(size)] = "w" + str(rnd.randint(0, 3))
            rows.append((len(rows), " ".join(words[: rnd.randint(size - 2, size)])))
    sets = shingle_sets(rows)
    wanted = {(i, c) for (i, _), c in zip(rows, brute_components(rows, sets), strict=True)}
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == wanted


def test_one_of_each_group_stays(spark, docs, texts):
    sets = shingle_sets(texts)
    component = brute_components(texts, sets)
    kept = jaccard_join.without_near_copies(docs).collect()
    wanted = {i for (i, _), c in zip(texts, component, strict=True) if i is None or i == c}
    assert Counter(r.doc_id for r in kept) == Counter(wanted)
    # rows that share an id only are documents of their own
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "P q r s t u v"), (4, ""), (4, "")]
    left = jaccard_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text.lower()) for r in left) == Counter([(1, "a b c d e f g"), (1, "p q r s t u v"), (4, ""), (4, "")])


def test_small_sets_boundary():
    assert jaccard_join.small_boundary({}) >= 5
    assert jaccard_join.need(10, 10) == 9 and jaccard_join.prefix(10) == 3


def test_license_scan(docs, nothing, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    wanted = Counter()
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at = {(j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()}
        where = [j for j, _ in at]
        wanted[i, len(w), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in at}))] += 1
    rows = license_scan.license_scan(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == wanted
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert license_scan.license_scan(nothing).count() == 0


def test_license_spans(spark):
    label, notice = license_scan.TEMPLATES[0]
    edited = notice.replace("without restriction, including", "with no other restriction than including")
    rows = [(1, "some words before it\n" + notice + "\nafter"), (2, "code here " + edited), (3, notice[:90]), (4, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == label and found[1].score == 1.0 and found[1].spans[0].start == 4
    assert found[2].labels == label and 0.9 < found[2].score < 1
    assert found[3].labels == "" and found[4].labels == "cc-by-nc"


def test_language_model(docs, nothing, texts):
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in texts]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in texts]
    count = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    total, distinct = sum(count.values()), len(count)
    for limit in (language_model.MAX_FREQUENT, 30):  # with and without a long tail
        rows = language_model.score(docs, max_frequent=limit).collect()
        wanted = defaultdict(list)
        for (i, _), t, h in zip(texts, tokens, held, strict=True):
            wanted[i].append((h, len(t), sum(count[x] > 0 for x in t), total, sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in t)))
        found = defaultdict(list)
        for r in rows:
            found[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
            assert r.score < 0
        for i, want in wanted.items():
            assert all(w[:4] == f[:4] and near(w[4], f[4]) for w, f in zip(sorted(want), sorted(found[i]), strict=True))
    assert language_model.score(nothing).count() == 0


def plain_license(text: str) -> tuple[str, float]:
    """Labels and best score by aligning every template with every stretch of the text that shares a run of K words with it."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    words, good = split(text), []
    for label, template in license_scan.TEMPLATES:
        wanted, k = split(template), license_scan.K
        votes = Counter((i - j) for i in range(len(words) - k + 1) for j in range(len(wanted) - k + 1) if words[i : i + k] == wanted[j : j + k])
        if not votes:
            continue
        low, high = max(0, min(votes)), max(votes) + len(wanted)
        near = words[max(0, low - len(wanted)) : high + len(wanted)]
        blocks = [b for b in difflib.SequenceMatcher(None, near, wanted, autojunk=False).get_matching_blocks() if b.size]
        score = sum(b.size for b in blocks) / len(wanted)
        if score >= license_scan.MIN_SCORE and sum(votes.values()) >= max(1, int(license_scan.MIN_VOTES * (len(wanted) - k + 1))):
            at = max(0, low - len(wanted))
            good.append((score, at + blocks[0].a, at + blocks[-1].a + blocks[-1].size, label))
    best = [g for g in good if not any(h[0] > g[0] and h[1] < g[2] and g[1] < h[2] for h in good)]
    return ",".join(sorted({g[3] for g in best})), max((g[0] for g in best), default=0.0)


def test_license_labels_against_plain_alignment(spark):
    rnd = random.Random(15)
    filler = lambda n: " ".join(rnd.choice(["code", "main", "int", "return", "value", "list", "read"]) for _ in range(n))
    rows = []
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        rows.append((3 * i, f"{filler(9)}\n{text}\n{filler(5)}"))
        words = text.split()
        for _ in range(max(1, len(words) // 30)):
            words[rnd.randrange(len(words))] = "altered"
        rows.append((3 * i + 1, f"# {filler(2)} " + " ".join(words)))
        rows.append((3 * i + 2, " ".join(text.split()[: max(3, len(words) // 3)]) + " " + filler(6)))
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        labels, score = plain_license(text)
        base = set(filter(None, found[i].base_labels.split(",")))
        assert set(filter(None, found[i].labels.split(","))) == base | set(filter(None, labels.split(","))), (text, found[i])
        assert near(found[i].score, score)
    for i, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[3 * i].labels.split(",") and found[3 * i].score == 1.0


def plain_score(text: str | None, counts: Counter, own: list[str], most: int, code, model) -> float:
    """The model's log10 probability of a text, token by token, each softmax written out."""
    ends = {x: len(own) + code(x) % most for x in counts if x not in own}
    sizes, words = Counter(), Counter()
    for x, k in ends.items():
        sizes[k] += counts[x]
        words[k] += 1
    a = b = len(model.bias)
    total = 0.0
    for x in [*WORD.findall((text or "").translate(LOW)), None]:
        w = own.index(x) if x in own else len(own) + code(x) % most
        logits = [float((model.r[j] * (model.c1 * model.q[a] + model.c2 * model.q[b])).sum() + model.bias[j]) for j in range(len(model.bias))]
        high = max(logits)
        total += (logits[w] - high - math.log(sum(math.exp(y - high) for y in logits))) / math.log(10)
        if x not in own:
            total += math.log10((counts[x] + 1) / (sizes[w] + words[w] + 1))
        a, b = b, w
    return total


def test_language_model_against_plain_sums(spark, docs, texts):
    count = Counter(x for i, t in texts for x in [*WORD.findall((t or "").translate(LOW)), None] if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2)
    for limit in (language_model.MAX_FREQUENT, 30):
        _, v, model = language_model.fit(docs, max_frequent=limit)
        known = {int(language_model.tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0]): x for x in count if x is not None}
        own = [None, *(known[int(h)] for h in v.own[1:])]
        code = lambda x: int(language_model.tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[1][0])
        found = {r.doc_id: r.score for r in language_model.score(docs, max_frequent=limit).collect()}
        for i, t in texts:
            if i in (0, 45, 92, 93, 95, 96, 99, 102, 204):
                assert math.isclose(found[i], plain_score(t, count, own, v.ends, code, model), rel_tol=1e-4), (i, limit)


def tongue(rnd: random.Random, ends: list[str], n: int) -> str:
    return " ".join("".join(rnd.choice("bcdfgh") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) + rnd.choice(ends) for _ in range(n))


def test_held_out_texts_gain_and_partitions_do_not_matter(spark):
    rnd = random.Random(13)
    rows = [(i, tongue(rnd, ["ing", "tion", "ed", "ly"] if i % 2 else ["chen", "ung", "keit", "lich"], 60)) for i in range(1500)]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for n in (4, 16, 64):
        found = language_model.score(base.repartition(n)).where("held_out").select("doc_id", "n_tokens", "score", "base_score").collect()
        size = sum(r.n_tokens for r in found)
        assert sum(r.score for r in found) / size > sum(r.base_score for r in found) / size + 0.1
        scores.append({r.doc_id: r.score for r in found})
    assert all(math.isclose(x, other[i], rel_tol=1e-6) for other in scores[1:] for i, x in scores[0].items())


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(2)
    sizes = np.zeros(50, np.int64)
    sizes[:6] = 5000
    trainer = language_model.Trainer(language_model.Model.start(sizes), language_model.Model.of(np.full(51 * 16 + 50 * 16 + 32 + 50, 1e-5), 50), sizes, 1)
    b = rng.integers(0, 6, 60_000)
    w = (b + 1) % 6  # the next class follows from the one before
    trainer.feed(np.stack([rng.integers(0, 6, 60_000), b, w]))
    trainer.flush()
    model = trainer.m
    first, second = model.halves()
    a = rng.integers(0, 6, 50)
    p = np.exp(first[a] + second[b[:50]] - model.norm()[a, b[:50]][:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert p[np.arange(50), w[:50]].mean() > 0.5


def test_patience():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    pairs = line_dedup.patience([1, 5, 5, 2, 7, 3], [1, 5, 2, 8, 3])
    assert all([1, 5, 5, 2, 7, 3][i] == [1, 5, 2, 8, 3][j] for i, j in pairs)
    assert pairs == sorted(pairs) and {(0, 0), (3, 2), (5, 4)} <= set(pairs)
    assert line_dedup.patience([], [1]) == []


def test_line_dedup(docs, nothing, texts):
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == len(texts) and line_dedup.line_dedup(nothing).count() == 0
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
    original = dict(texts)
    assert left[92][0].text is None and left[93][0].text == "" and left[94][0].text == " \n\t "
    assert left[90][0].text == "" and left[91][0].text == ""  # copies of an earlier document
    assert left[0][0].text == original[0] and all(r.text == original[5] for r in left[5])
    passage = original[40].split("\n")[1]
    assert passage in left[40][0].text
    for i in range(41, 60):
        head, _, tail = original[i].split("\n")
        assert left[i][0].text == f"{head}\n{tail}" and left[i][0].lines_deleted == 1
    keep = [x for x in original[105].split("\n") if len(x.split()) < line_dedup.MIN_WORDS]
    assert left[105][0].text == "\n".join(keep)
    assert "new words between them" in left[106][0].text
    assert left[103][0].text == original[103]


def passages_gone(rows: list[tuple], min_words: int) -> dict:
    """Lines of each document that lie in an equal run with any earlier document, by comparing all pairs of lines."""
    lines = {i: t.split("\n") for i, t in rows}
    out = {i: set() for i, _ in rows}
    for d in lines:
        mine = lines[d]
        enough = min(min_words, sum(len(x.split()) for x in mine))
        for e in lines:
            if e >= d:
                continue
            for i in range(len(mine)):
                for j in range(len(lines[e])):
                    n = 0
                    while i + n < len(mine) and j + n < len(lines[e]) and mine[i + n] == lines[e][j + n]:
                        n += 1
                    if n and sum(len(x.split()) for x in mine[i : i + n]) >= enough > 0:
                        out[d] |= set(range(i, i + n))
    return out


def test_line_dedup_moved_and_repeated(spark):
    p = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(10)]
    short = [f"s{i} a b c d" for i in range(3)]
    cases = [
        (1, [p[0], "x one", p[0]]), (2, ["y two", p[0], "z three"]), (3, ["q four", p[0], "r", p[0]]),  # held twice
        (10, [p[1], "x five", p[2]]), (11, [p[2], "y six", p[1]]),  # in another order
        (20, p[3:]), (21, [x for i, y in enumerate(p[3:][::-1]) for x in (y, f"between {i}")]),
        (30, [short[0], "t seven"]), (31, [short[1], "t eight"]), (32, [short[2], "t nine"]), (33, ["u", *short, "v"]), (34, ["w ten", *short, "w eleven"]),  # a run whose lines have other first holders
        (40, ["k l", "m", "k l", "n"]), (41, ["m", "k l"]), (42, ["", "k l", "", "n"]), (43, ["k l", "n"]), (44, ["n", "k l"]),  # all the words of a short text
    ]
    rows = [(i, "\n".join(x)) for i, x in cases]
    rnd = random.Random(10)
    pool = ["", "a", "b b", "c c c", "d d d d", "e e e e e", "f f f f f f", "g g g g g g g g g g", "h h h h h h h h h h h"]
    rows += [(100 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(250)]
    found = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    gone = passages_gone(rows, line_dedup.MIN_WORDS)
    for i, text in rows:
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines) if n not in gone[i]]
        if len(text.split()) < line_dedup.MIN_WORDS:  # lines without words stand beside all its words as in one holder
            assert found[i].text.split() == " ".join(left).split()
        else:
            assert found[i].text == "\n".join(left) and found[i].lines_deleted == len(gone[i])
    assert found[2].text == "y two\nz three" and found[11].text == "y six" and found[34].text == "w ten\nw eleven"


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {90, 91, 92, 93, 94}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids


def plain_line_dedup(rows: list[tuple]) -> dict:
    gone = passages_gone([(i, t or "") for i, t in rows], line_dedup.MIN_WORDS)
    out = {}
    for i, t in rows:
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
        if not gone[i] or WORD.search(left):
            out[i] = left if gone[i] else t
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() against brute-force versions of its stages, with nulls, copies, passages, toxic and short documents."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(17)
    word = lambda: rnd.choice(["lo", "mi", "ra", "te", "su"]) + rnd.choice(["na", "ko", "vi", "du"]) + str(rnd.randint(0, 60))
    line = lambda n: " ".join(word() for _ in range(n))
    rows: list[tuple] = [(i, "\n".join(line(rnd.randint(4, 14)) for _ in range(rnd.randint(3, 8)))) for i in range(120)]
    passage = line(60)
    rows += [(200 + i, f"{line(20)}\n{passage}\n{line(12)}") for i in range(10)]
    rows += [(300 + i, rows[i][1]) for i in range(6)]  # exact copies
    for i in range(6):  # near copies on one line, so that no line is shared
        text = " ".join(rows[10 + i][1].split())
        rows += [(400 + 2 * i, text + " one more"), (401 + 2 * i, text + " another one")]
    for i in range(40):  # toxic passages in clean prose
        words = line(90).split()
        for j in range(3, 90, 14):
            words[j] = rnd.choice(["vile", "foul"])
        rows.append((500 + i, " ".join(words)))
    rows += [(600, None), (601, ""), (602, "too short"), (603, "again and again " * 12)]
    labels = [(i, 1, 0) for i in range(100)] + [(500, 1, 1), (None, 1, 0), (7, None, None)]

    def store(folder, rows, labels):
        spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))

    store(tmp_path / "some", rows, labels)
    ratio = plain_ratio(rows, set(range(100)))
    left = [(i, t) for i, t in rows if not figures(t)[5] and ratio[i] >= quality.THRESHOLD]
    assert {i for i, _ in rows} - {i for i, _ in left} == {*range(500, 540), *range(600, 604)}
    left = sorted(plain_line_dedup(left).items())
    component = brute_components(left, shingle_sets(left))
    kept = {i: t for (i, t), c in zip(left, component, strict=True) if i == c}
    ids = {i: [*e.ids, 2] for i, e in zip(kept, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(list(kept.values()), add_special_tokens=False), strict=True)}
    found = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in found} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert not {r.doc_id for r in found} & {300, 301, 302, 303, 304, 305} and all(400 + 2 * i not in kept or 401 + 2 * i not in kept for i in range(6))
    # tables without rows, and rows that repeat
    store(tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    store(tmp_path / "twice", rows[:5] * 2, labels)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "twice")).collect()) == Counter(range(5))


def test_columns_of_any_name_keep_their_values(docs, spark):
    """Whatever operators name their own columns, those of the documents stay as they are."""
    for out in (line_dedup.line_dedup(docs), jaccard_join.without_near_copies(docs)):
        rows = out.collect()
        assert rows and all(r[c] == f"kept {c}" for r in rows for c in INSIDE)


def test_ids_of_any_type_and_name(spark, texts):
    """String ids, in columns that operators name so themselves."""
    labels = spark.createDataFrame([("a1", 1, 0), ("a2", 1, None), ("a3", 0, 1)], "key string, quality int, toxic int")
    rows = [(None if i is None else f"a{i}", t, "text", "clash") for i, t in texts[:60]]
    df = spark.createDataFrame(rows, "key string, body string, text string, id string")
    wanted = sorted(str(r[0]) for r in rows)
    for found in (
        license_scan.license_scan(df, "key", "body"),
        quality.quality_rules(df, labels, "key", "body"),
        line_dedup.line_dedup(df, "key", "body"),
        jaccard_join.jaccard_join(df, "key", "body"),
    ):
        assert sorted(str(r["key"]) for r in found.collect()) == wanted
    assert set(quality.good_documents(df, labels, "key", "body").columns) == set(df.columns)
    numbered = spark.createDataFrame([(i, t) for i, t in texts[:20] if i is not None], "key long, body string")
    assert quality.quality_rules(numbered, labels, "key", "body").count() == numbered.count()  # labels that are no numbers are of no document


def test_classes_are_a_parameter(docs):
    sizes = [language_model.fit(docs, rounds=1, max_classes=n)[1].classes for n in (3, 20)]
    assert sizes[0] <= 7 < sizes[1]
    for wrong in (0, 1 << 15):
        with pytest.raises(ValueError, match="max_classes"):
            language_model.fit(docs, max_classes=wrong)
