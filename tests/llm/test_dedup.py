"""Line, passage and near-duplicate removal and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_documents import DOCS, odd_texts, prose

from pyspark.sql import functions as F

from cityrhythm.llm import bloom, decontam, linedup, minhash, suffixdup
from cityrhythm.llm import text as tx

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words_agree_with_patterns():
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ09 \t\n\x0b.-é日\x00~") for _ in range(n)) for n in (0, 1, 5, 100, 3000)] * 3 + ["w" * 70_000]
    old, tx.STRETCH = tx.STRETCH, 512
    try:
        for mask, pattern in ((tx.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tx.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            got = []
            for a, b, buf, off in tx.texts(pa.array([t.encode() for t in texts], pa.binary())):
                s, e, h, first = tx.words(buf, off, mask)
                low = tx._LOWER[buf]
                for r in range(b - a):
                    got.append([low[x:y].tobytes().decode() for x, y in zip(s[first[r]:first[r + 1]], e[first[r]:first[r + 1]])])
            assert got == [re.findall(pattern, t.translate(LOWER)) for t in texts]
    finally:
        tx.STRETCH = old


def test_twice_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**62, 3000)
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([values, values[:700]])], "h long").repartition(5)

    def hashes(batches):
        for b in batches:
            yield b["h"].to_numpy().view(np.uint64)

    twice = bloom.filters(df, hashes, bloom.MIN_BITS).value
    assert bloom.has(twice, values[:700].view(np.uint64)).all()
    assert bloom.has(twice, values[700:].view(np.uint64)).mean() < 0.01


def brute_lines(rows, min_chars, min_docs):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append((i is not None, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= min_docs and max(held[key(x)])[1] != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, None if t is None else kept, len(lines), sum(gone)))
    return out


def test_line_dedup(spark, odd, no_docs):
    got = linedup.dedup_lines(odd, min_chars=40, min_docs=5)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    exp = brute_lines(rows, 40, 5)
    assert sum(x[3] for x in exp) >= 7
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == Counter(exp)
    assert linedup.dedup_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        linedup.dedup_lines(no_docs, min_docs=1)


def brute_passages(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        gone[len(t)] = False
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("group", [1000, 2])
def test_passages(spark, odd, no_docs, monkeypatch, group):
    monkeypatch.setattr(suffixdup, "MAX_GROUP", group)
    rng = random.Random(21)
    rows = [(900, "a" * 30_000), (901, "b" + "a" * 200 + "c"), (902, "a" * 199), (903, "1234567" * 3000 + "x" + "1234567" * 40), (904, "x" + ("3456712" * 40)[:205]),
            (905, "\n" * 20_000), (906, prose(rng, 40) + "\n \n" * 900 + prose(rng, 40)), (907, "".join(chr(97 + i) for i in range(26)) * 40),
            (908, ("".join(rng.choice("abcdefgh") for _ in range(48))) * 9 + "end"), (909, ("".join(rng.choice("abcdefgh") for _ in range(90))) * 9), (910, "z" * 201), (911, "y" * 200)]
    small = odd.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("i", F.lit("own"))
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    exp = Counter((i, *x[:3], None if t is None else x[3]) for (i, t), x in
                  zip(rows, brute_passages([(t or "").encode() for _, t in rows], 200)))
    got = suffixdup.remove_repeats(small, length=200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, None if r.kept is None else bytes(r.kept)) for r in got.collect()) == exp
    assert suffixdup.remove_repeats(no_docs).count() == 0


def test_passages_across_chunks(spark, monkeypatch):
    rng = random.Random(9)
    part = prose(rng, 90)
    texts = [prose(rng, 700) + part + prose(rng, 300), prose(rng, 50) + part, "ab" * 2000, prose(rng, 400)]
    import pyarrow as pa
    monkeypatch.setattr(suffixdup, "CHUNK", 1000)
    seg = []
    for _, _, buf, off in tx.texts(pa.array([t.encode() for t in texts], pa.binary())):
        for first, n, _, _ in suffixdup.segments(buf, off, 200, []):
            seg += [(a, a + k) for a, k in zip(first.tolist(), n.tolist())]
    starts, at = [], 0
    for t in texts:
        starts += range(at, at + len(t.encode()) - 199)
        at += len(t.encode())
    assert sorted(x for a, b in seg for x in range(a, b)) == starts     # each window lies in one segment


def brute_near(rows, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((d, len(sets[i]), comp if sets[i] else d, d == (comp if sets[i] else d)))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd, no_docs, percent):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(odd, percent=percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(map(tuple, got.collect())) == Counter(brute_near(rows, percent))
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group of near copies of one text, linked mostly by way of the original, in many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    rng = random.Random(4)
    base = prose(rng, 100).split(" ")
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 80):
        w = list(base)
        for k in rng.sample(range(100), rng.choice((1, 1, 2, 2, 3, 6))):
            w[k] = f"new{i}{k}"
        rows.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    got = minhash.near_duplicates(df, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    exp = brute_near([r[:2] for r in rows], 85)
    assert 5 < sum(x[3] for x in exp) < 70
    assert sorted(map(tuple, got)) == sorted(exp)


def test_main_classes_are_shipped_once(spark, monkeypatch):
    """Near copies of one text, three of them outside the main component: rows to compare grow with the classes, not with their square."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    shipped, links = [], minhash._links

    def counted(pairs, sets, percent):
        shipped[-1] += pairs.count()
        return links(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_links", counted)
    for n in (80, 240):
        rng = random.Random(5)
        base = prose(rng, 100).split(" ")
        rows = []
        for i in range(n):
            w = list(base)
            for k in rng.sample(range(100), 5 if i in (7, 27, 47) else 1):
                w[k] = f"new{i}{k}"
            rows.append((i, " ".join(w), "en", "s", 1))
        shipped.append(0)
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), percent=85).select("doc_id", "n_shingles", "component_id", "kept")
        assert sorted(map(tuple, got.collect())) == sorted(brute_near([r[:2] for r in rows], 85))
    assert shipped[1] < 4 * shipped[0]


@pytest.mark.parametrize("percent", [1, 10, 30, 50, 70, 80, 85, 95, 99, 100])
def test_bands_follow_the_threshold(percent):
    bands, rows = minhash.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSED


def test_near_duplicates_at_a_low_threshold(spark):
    """Pairs of a little over half of their shingles: none is missed."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"w{i}x{k}" for k in range(100)]
        rows.append((2 * i, " ".join(w), "en", "s", 1))
        rows.append((2 * i + 1, " ".join(w[:68] + [f"v{i}x{k}" for k in range(rng.choice((30, 32)))]), "en", "s", 1))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), percent=50).select("doc_id", "n_shingles", "component_id", "kept")
    exp = brute_near([r[:2] for r in rows], 50)
    assert sum(x[3] for x in exp) == 60
    assert sorted(map(tuple, got.collect())) == sorted(exp)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 0.5) < 0.08
    assert len(minhash.band_keys(minhash.signature(a))) == minhash.BANDS


def brute_contamination(rows, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w and i is not None else ():
            grams[tuple(w[p:p + n])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, got = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in grams:
                    hit.update(range(p, p + n))
                    got |= grams[tuple(w[p:p + n])]
        out.append((i, len(w), len(hit), len(got), tuple(sorted(got)), bool(hit)))
    return out


def test_contamination_of_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 7)
    items = [(1, "the"), (2, "a b"), (3, "x y z"), (4, "x y z x y z x y z x"), (5, "the the the the"), (6, "p q r s t u v w")]
    rows = [(0, "the " * 50), (1, "a b " * 30), (2, "x y z " * 20), (3, "y z " + "x y z " * 9 + "the"), (4, "p q r s t u v w"), (5, "x y"),
            (6, "o p q r s t u v w " * 8 + "p q r s t u v"), (7, "z x y z a")]
    rows += [rows[0], rows[2]]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(2),
                                 spark.createDataFrame(items, "item_id long, text string"), window=10).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got]
    assert sorted(got) == sorted(brute_contamination(rows, items, 10))


def test_contamination(spark, odd, no_docs):
    texts = odd_texts()
    items = [(1, texts[10][50:200]), (12, texts[10].upper()[150:400]), (2, "one"), (3, "One, two!"), (4, None), (5, ""), (None, "beta"),
             (6, texts[30]), (6, texts[30]), (7, "nothing of this kind occurs in any of them, not even once")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = decontam.contamination(odd, bench, window=10)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got.collect())
    exp = brute_contamination(rows, items, 10)
    assert sum(x[5] for x in exp) > 4
    assert got == Counter(exp)
    assert decontam.contamination(no_docs, bench).count() == 0
    clean = decontam.contamination(odd, bench.limit(0))
    assert clean.count() == len(rows) and clean.where("contaminated").count() == 0


def test_removal_of_spans():
    text = b"0123456789"
    spans = [{"a": 2, "b": 4}, {"a": 4, "b": 5}, {"a": 3, "b": 5}, {"a": 8, "b": 10}]
    assert suffixdup.without(text, spans) == (10, 5, 2, b"01567")
    assert suffixdup.without(None, None) == (0, 0, 0, None)
    assert hashlib.sha256(suffixdup.without(text, None)[3]).digest() == hashlib.sha256(text).digest()
