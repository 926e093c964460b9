"""Neighbours, languages, resampling, licences, mixing and WARC bundles."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import struct
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import zstandard
from odd_documents import DOCS, prose
from pyspark.sql import functions as F

from cityrhythm.llm import ann, langid, license, mixing, queries, resample, store, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_neighbours(rows, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    x = {i: np.array(v, np.float64) for i, v in best.items()}
    out = {}
    for q in (i for i in x if i % 50 == 0):
        s = sorted((-(x[q] @ x[i]) / (np.linalg.norm(x[q]) * np.linalg.norm(x[i])), i) for i in x if i != q and len(x[i]) == len(x[q]))
        out[q] = [(i, -c) for c, i in s[:k]]
    return out


def neighbours_of(df):
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [v[i] for i in sorted(v)] for q, v in got.items()}


def test_neighbours_of_odd_vectors(spark):
    """Few vectors: every query gets all there are, ties by id; odd vectors take no part."""
    f = float
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.5]), (50, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]),
            (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [f("nan"), 1.0, 0.0]), (8, [f("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]),
            (100, [1.0, 2.0]), (9, [1.0, 2.5]), (150, []), (200, [3.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got, exp = neighbours_of(df), brute_neighbours(rows, 5)
    exp = {q: v for q, v in exp.items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exp.items()}
    for q in exp:
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in exp[q]], atol=1e-12)
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_recall_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, exp = neighbours_of(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)), brute_neighbours(rows, 5)
    assert got.keys() == exp.keys() and all(len(v) == 5 for v in got.values())
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in exp[q]}) / 5 for q in exp]) >= 0.9


def test_probes_follow_the_buckets():
    share = []
    for count in (2_000, 300_000, 5_000_000, 300_000_000):
        layout = ann.Layout(count)
        x = np.random.default_rng(2).normal(size=(2, 64))
        probes = layout.probes(x, 0)
        assert all(len(np.unique(p)) == layout.looked(64) for p in probes)
        assert [p[0] for p in probes] == layout.codes(x, 0).tolist()
        share.append(layout.looked(64) / layout.buckets(64))
    assert share == sorted(share, reverse=True) and share[-1] ** 2 * ann.Layout(300_000_000).buckets(64) > 3.9


def test_neighbours_of_very_large_and_small_components(spark):
    """Neither squares out of range nor another order: the cosine doesn't depend on lengths."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.choice([-200, -20, 0, 160, 300])).tolist()) for i in range(80)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got, exp = neighbours_of(df), brute_neighbours([(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows], 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exp.items()}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = ann.rotated(x, 2, 1)
    np.testing.assert_allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(y @ y.T, x @ x.T)


def test_words_are_summed_over_all_segmentations():
    v = langid.vocabulary(langid.VOCABULARY)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    pieces = {bytes([b]) for b in range(256)} | {sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (
        sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and "▁▁" not in sp.id_to_piece(i)}
    assert v.size == len(pieces)
    prob = np.random.default_rng(0).random((v.size + 1, 2))
    prob[-1] = 0
    prob /= prob.sum(axis=0)

    def number(p):
        rows = np.frombuffer(p, np.uint8)[None, :]
        return int(dict((size, ids[0]) for size, ids in v.edges(rows)[len(p)])[len(p)])
    for w in langid.as_bytes("thé") + langid.as_bytes("nation") + langid.as_bytes("q" * 40):
        a, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        edges = [(i, j, prob[number(w[i:j]), 1]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in pieces]
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p for i, k, p in edges if k == j)
        for i in range(len(w) - 1, -1, -1):
            b[i] = sum(b[j] * p for k, j, p in edges if k == i)
        assert langid.word_scores(v, [w], prob)[0, 1] == pytest.approx(math.log(a[-1]))
        got = langid.expected(v, [w], np.array([3]), prob[:, 1])
        assert got.sum() == pytest.approx(3 * sum(a[i] * p * b[j] for i, j, p in edges) / a[-1])


def test_languages(spark, odd, no_docs):
    d = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(d)
    docs = docs.withColumn("held_out", langid.held_out(docs))
    model = langid.fit(docs.where("not held_out"))
    got = langid.predict(docs, model)
    right = got.where("held_out and lang = lang_pred").count() / got.where("held_out").count()
    assert right >= 0.97
    out = langid.predict(odd, model)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    rows = out.select("text", "lang_pred", "score").collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.lang_pred in model.languages) == letters
        assert 0 <= r.score <= 1
    nothing = langid.fit(no_docs)
    assert nothing.languages == []
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_held_out_is_crc32(spark):
    import zlib
    df = spark.range(20).withColumnRenamed("id", "doc_id")
    assert [r[0] for r in df.orderBy("doc_id").select(langid.held_out(df)).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(20)]


def test_resampling(spark, odd, no_docs):
    rng = random.Random(6)
    good = [(i, prose(rng, 60), "en", "s", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 60).split()), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(good + bad, DOCS)
    target = spark.createDataFrame([(i,) for i in range(0, 150, 2)] + [(None,), (0,)], "doc_id long")
    got = {r.doc_id: r for r in resample.resample(docs, target, keep=0.75).collect()}
    assert sum(r.kept for r in got.values()) == math.ceil(0.75 * 190)
    assert not any(got[1000 + i].kept for i in range(40))
    order = sorted(got.values(), key=lambda r: -r.gumbel_key)
    assert all(r.kept for r in order[:143]) and not any(r.kept for r in order[143:])
    none = resample.resample(odd, target.limit(0)).collect()
    assert len(none) == odd.count() and {r.log_weight for r in none} == {0.0}
    assert {r.log_weight for r in resample.resample(odd.where("coalesce(text, '') = ''"), target).collect()} == {0.0}
    assert resample.resample(no_docs, target).count() == 0


def test_share_kept_follows_labels(spark, tmp_path):
    rows = [(i, int(i % 5 < 3), 0) for i in range(100)] + [(3, 1, 0), (None, 1, 0), (500, None, 0), (0, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    both = F.expr("quality is not null"), F.expr("quality = 1 and coalesce(toxic, 0) = 0")
    assert resample.target_share(labels, *both) == 0.61 and resample.target_share(labels.limit(0), *both) == 1.0
    rng = random.Random(8)
    spark.createDataFrame([(i, prose(rng, 20), "en", "s", 1) for i in range(200)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op5_importance_resampling(spark, str(tmp_path)).where("kept").count() == 122


@pytest.mark.parametrize("k", [1, 2, 500, 6000, 9000, 12_001])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(6) for _ in range(4000)] + [2.5] * 8001
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(4)
    assert resample.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_licences(spark, odd, no_docs):
    full = license.TEMPLATES["MIT-text"]
    texts = ["words before.\nReleased under the MIT License.", "x licensed under the apache license version 2.0", full.replace("free of charge", "free of cost"),
             "All rights reserved", "all rights are reserved", "permission is hereby granted to nobody at all, whatever he may have been told", full * 3, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {}
    for r in license.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    named = {i: [(r.template, r.confirmed) for r in v] for i, v in got.items()}
    assert named[0] == [("MIT", True)] and named[1] == [("Apache-2.0", True)] and named[2] == [("MIT-text", True)] and named[3] == [("all-rights-reserved", True)]
    assert got[2][0].differences == ["-charge", "+cost"] and got[2][0].missing == 1
    assert not any(ok for _, ok in named[5]) and 4 not in named and 7 not in named and 8 not in named
    assert named[6] == [("MIT-text", True)] * 3
    assert all(0 < r.reduction < 1 for v in got.values() for r in v)
    assert license.scan(odd).count() == 0 and license.scan(no_docs).count() == 0
    assert license.scan(docs, templates={}).count() == 0


def test_adjacent_licences(spark):
    """Blocks longer than a part lose no notice where they are cut."""
    seps = [" Copyright 2020 Jane Doe ", " "]
    docs = [(i, k, sep.join([v] * 60)) for i, ((k, v), sep) in enumerate((x, y) for x in license.TEMPLATES.items() for y in seps)]
    got = {}
    for r in license.scan(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")).where("confirmed").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, k, _ in docs:
        rows = sorted(got[i], key=lambda r: r.start)
        assert [r.template for r in rows] == [k] * 60 and not any(r.missing or r.other for r in rows)
        assert len({b.start - a.start for a, b in zip(rows, rows[1:])}) == 1


def test_short_licences_beside_long_ones(spark):
    """A notice is found whatever the rank of its template, and beside copies that have other words of it."""
    mit, gpl = license.TEMPLATES["MIT-text"], license.TEMPLATES["GPL-3.0-header"]
    texts = [f"All rights reserved. {' '.join(mit.split()[:40])}",
             "All rights reserved. Permission to use and copy this software for any purpose is hereby given to all, provided that the above "
             "copyright notice appear in all copies. Licensed by the Apache people, you may not use this file except in compliance.",
             f"{gpl.replace('software', 'ware').replace('either', 'or')} {gpl.replace('program', 'file').replace('any', 'a')}"]
    got = {}
    for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.template, r.confirmed, r.start))
    assert got[0] == got[1] == [("all-rights-reserved", True, 0)]
    assert sorted(got[2], key=lambda r: r[2]) == [("GPL-3.0-header", True, 0), ("GPL-3.0-header", True, len(license.word_list(gpl.encode())))]


def test_texts_unlike_their_language(spark, odd, no_docs):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(60)) for _ in range(50)]
    finnish = ("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
               "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä").split()
    noise += [" ".join(rng.choices(finnish, k=60)) for _ in range(50)]
    rows = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(noise)] + [(2 * 10**9, None, "en"), (2 * 10**9, " 1 ", None)],
                                 docs.schema)
    model = langid.fit(docs)
    got = store.materialise(langid.predict(docs.unionByName(rows), model, fit=True), "predicted")
    gone = {r.doc_id for r in langid.unlike(got).where("unlike").collect()}
    assert gone == {10**9 + i for i in range(100)}
    out = langid.unlike(langid.predict(odd, model, fit=True).withColumn("unlike", F.lit("own")))
    assert out.count() == odd.count() and dict(out.dtypes)["unlike"] == "boolean"
    assert langid.unlike(langid.predict(no_docs, model, fit=True)).count() == 0
    assert not langid.unlike(langid.predict(docs, langid.fit(no_docs), fit=True)).where("unlike").count()


@pytest.mark.parametrize("share", [[1, 2, 3, 4], [5, 5], [1, 99], [7] * 13, [1], [3, 1, 1, 2, 57]])
def test_schedule_deviates_by_less_than_a_block(share):
    period, had = sum(share), [0] * len(share)
    for t, (slot, i, k, release, due) in enumerate(mixing.schedule(share)):
        assert slot == t and k == had[i] and release <= t < due
        had[i] += 1
        assert all(abs(h * period - s * (t + 1)) < period for h, s in zip(had, share))
    assert had == share


def test_schedule_of_a_million_blocks_keeps_exact_weights():
    weights = [0.5, 0.3, 0.15, 0.0499, 0.0001 + 1e-11]
    exact = [Fraction(repr(w)) for w in weights]
    total, had = sum(exact), [0] * 5
    share = mixing.shares(exact)
    assert sum(share) > 10**6
    for t, i, *_ in itertools.islice(mixing.schedule(share), 10**6):
        had[i] += 1
        if t % 9973 == 0 or t > 10**6 - 100:
            assert all(abs(h - w / total * (t + 1)) < 1 for h, w in zip(had, exact))


def test_schedule_leaves_ended_sources_out():
    got = list(mixing.schedule([3, 2, 5], [1, 2, 4]))
    assert sorted((i, k) for _, i, k, _, _ in got) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert len({t for t, *_ in got}) == len(got) and all(r <= t < d for t, _, _, r, d in got)


def test_shares():
    assert mixing.shares([Fraction("0.5"), Fraction("0.25"), Fraction("0.25")]) == [2, 1, 1]
    assert mixing.shares([Fraction(6), Fraction(4)]) == [3, 2] and mixing.shares([]) == []
    fine = mixing.shares([Fraction(1, 3), Fraction(repr(1e-17)), Fraction(repr(2**0.5))])
    assert min(fine) == 1 and abs(sum(fine) - mixing.FINEST) < 5


def test_mixing_of_many_sources_and_own_columns(spark):
    rows = [(i, "text " * (i % 7), f"s{i % 20_000}", "own id", "own i", "own k") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id string, __I string, ___k string")
    got = mixing.mix(docs, block_bytes=16).collect()
    assert len(got) == 40_000 and {(r["__id"], r["__I"], r["___k"]) for r in got} == {("own id", "own i", "own k")}
    assert len({(r.mix_slot, r.source) for r in got}) == len({r.mix_slot for r in got})
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)


def test_mixing(spark, odd, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 4)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en", ("a", "a", "b", None)[i % 4], i) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0, None: 1.0}, block_bytes=256).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    for s in ("a", "b", None):
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.mix_block, r.mix_slot))
        # blocks in order hold the source's bytes: what lies before a block's first document differs from its start by a document
        sizes = Counter()
        for r in own:
            sizes[r.mix_block] += len(r.text.encode())
            assert r.mix_release <= r.mix_slot < r.mix_deadline
        done = 0
        for b in sorted(sizes):
            assert 0 <= done - b * 256 < 600
            done += sizes[b]
    slots = {(r.mix_slot, r.source) for r in got}
    assert len({s for s, _ in slots}) == len(slots)         # one source a slot
    horizon = max(r.mix_slot for r in got if r.mixed)
    for t in range(0, horizon, 7):
        for s, w in (("a", 0.6), ("b", 0.2), (None, 0.2)):
            share = next(r.mix_weight for r in got if r.source == s)
            assert share == w
    out = mixing.mix(odd)
    assert out.count() == odd.count() and out.columns == odd.columns + mixing.COLUMNS
    assert mixing.mix(out).columns == out.columns
    assert mixing.mix(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0})


PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    monkeypatch.setattr(warc, "BUNDLE", 9000)
    monkeypatch.setattr(warc, "READ_FRAMES", 2)
    rng = random.Random(8)
    rows = [(i, f"http://x/{i} a\r\nWARC-Type: evil", prose(rng, rng.randrange(1, 200)), "own") for i in range(60)]
    rows += [(100, None, "é\r\n\r\nWARC/1.1\r\n\r\n", None), (101, "u", "é\r\n\r\nWARC/1.1\r\n\r\n", None), (102, "u", None, None), (103, "u", "", None),
             (104, "u", "tiny", None), (105, "u", "tiny", None), (106, "u", "q" * 100_000, None), (None, "u", "tiny", None), (107, "u", "same", None), (107, "u", "same", None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = f"file://{tmp_path}/bundles"
    index = warc.write(pages, path)
    got = warc.read(index, path).collect()
    body = {}
    for i, _, h, _ in rows:
        body.setdefault(h or "", []).append(i)
    exp = Counter()
    for i, u, h, _ in rows:
        last = max((x for x in body[h or ""] if x is not None), default=None)
        p = (h or "").encode()
        exp[i, "response" if i == last else "revisit", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None if i == last else last] += 1
    assert Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == exp
    text = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response")
    one = warc.fetch(index.where("page_id = 7"), path).first()
    head, _, payload, _ = warc.parse(bytes(one.record), 0)
    assert head["WARC-Record-ID"] == "<urn:page:7>" and payload == text[7] and "\n" not in head["WARC-Target-URI"]
    # frames decompress alone, the whole file as one stream, and the last frame is the seek table
    fs = pa.fs.LocalFileSystem()
    names = {r.bundle for r in index.select("bundle").distinct().collect()}
    assert len(names) > 3
    for n in names:
        with fs.open_input_file(n) as f:
            b = warc.Bundle(f)
            raw = f.read_at(f.size(), 0)
            whole = b"".join(b.frame(k) for k in range(len(b.frames)))
        assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole
        assert struct.unpack("<I", raw[sum(x[1] for x in b.frames):][:4])[0] == 0x184D2A5E


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc" * 9, ""), (4, "u", "abc" * 9, "")], PAGES)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, min_bytes=10).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damage_is_found():
    r = warc.record(1, "u", b"payload", "D", None, False)
    assert warc.parse(r, 0)[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(r[:-2], 0)
    with pytest.raises(ValueError):
        warc.parse(b"x" + r, 0)


def test_work_folder(spark):
    assert store.new_path(spark, "t").startswith(store.work_dir(spark))
