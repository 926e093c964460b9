"""Transducer BPE against the tokenizers library, conversation repair and source divergence against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pytest
from odd_documents import odd_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cityrhythm.llm import bpe, conversation, divergence, queries, transducer

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def strange_texts(rng: random.Random) -> list[str | None]:
    out = ["a" * 5000, "-" * 9999, "--==" * 3000, "é" * 3000, "x1" * 40_000, "it's'll-'sab's" * 9000, "<|endoftext|>x<|startoftext|><|endoftext|",
           "日本語" * 500, "Á b c\u0085d\x1ce\x0bf\x0cg", "İSTANBUL ΣΑΣ ß ŉ", "a　b c", None, "", " \n"]
    out += ["".join(rng.choice("abcXYZ019 '-_.,́éß日 　🎉‍\n\t<|>") for _ in range(rng.randrange(400))) for _ in range(500)]
    return out + ["".join(rng.choice("aeiounrst'-1") for _ in range(100_000)), "".join(rng.choice("thean") for _ in range(30_000))]


def test_transducer_is_minimal_and_exact():
    rng = random.Random(2)
    for n in (0, 1, 2, 300):
        words = sorted({bytes(rng.choice(b"abc\xff") for _ in range(rng.randrange(1, 7))) for _ in range(n)})
        pairs = [(w, tuple(rng.randrange(5) for _ in range(rng.randrange(4)))) for w in words]
        states = transducer.build(pairs)
        assert len(set(states)) == len(states)
        t = transducer.pack(states)
        asked = words + [w + b"a" for w in words] + [w[:-1] + b"z" for w in words]
        ends = np.cumsum([len(w) for w in asked], dtype=np.int64)
        buf = np.frombuffer(b"".join(asked), np.uint8)
        size, met = transducer.look_up(t, buf, ends - [len(w) for w in asked], ends)
        known = dict(pairs)
        assert [int(x) for x in size] == [len(known[w]) if w in known else -1 for w in asked]
        room = np.maximum(size, 0)
        first, out = np.cumsum(room) - room, np.empty(room.sum(), np.int32)
        transducer.write_out(t, met, size, first, out)
        assert all(tuple(out[a:a + k].tolist()) == known[w] for w, a, k in zip(asked, first, room) if w in known)
    # one state for all words with the same rest: "..ing" with equal ids
    same = [(x + b"ing", (7,)) for x in (b"a", b"b", b"c")]
    assert len(transducer.build(same)) == 5


def test_encoder_equals_the_library():
    rng = random.Random(4)
    texts = odd_texts() + strange_texts(rng)
    library = Tokenizer.from_file(TOKENS)
    arrays, more = bpe.model_arrays(TOKENS)
    model = bpe.Encoder(arrays, more)
    words = sorted({w.encode() for t in texts[::2] for w in (t or "").split() if len(w.encode()) <= bpe.WORD_BYTES})
    ids, n = model.words([w.decode() for w in words])
    ends = np.cumsum(n)
    pairs = [(w, tuple(ids[e - k:e].tolist())) for w, e, k in zip(words, ends, n)]
    full = bpe.Encoder(transducer.pack(transducer.build(pairs)) | arrays, more)
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for m in (model, full):
        got = m.encode(column)
        assert got.to_pylist() == expected
        assert m.decode(got).to_pylist() == [library.decode(e, skip_special_tokens=False) for e in expected]
    long = "".join(rng.choice("theanigro") for _ in range(3000))
    sym = np.array([int(model.inner[ord(c)]) for c in long[:-1]] + [int(model.last[ord(long[-1])])])
    assert model.merge_long(sym).tolist() == library.encode(long, add_special_tokens=False).ids


def test_encode_and_decode(spark, odd, no_docs):
    library = Tokenizer.from_file(TOKENS)
    for words in (bpe.LEXICON_WORDS, 3, 0):
        lexicon = bpe.compile_lexicon(spark, odd, TOKENS, words=words)
        assert lexicon.words <= words
        out = odd.withColumn("ids", bpe.encode(F.col("text"), lexicon)).withColumn("back", bpe.decode(F.col("ids"), lexicon))
        rows = out.select("text", "ids", "back", bpe.digest(F.col("ids")).alias("sha")).collect()
        assert len(rows) == odd.count()
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.back == library.decode(ids, skip_special_tokens=False)
            assert r.sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    lexicon = bpe.compile_lexicon(spark, no_docs, TOKENS)
    assert lexicon.words == 0 and no_docs.select(bpe.encode(F.col("text"), lexicon).alias("ids")).collect() == []
    with pytest.raises(ValueError):
        bpe.model_arrays(public_tokenizers.path("byte_bpe_50k.json"))


def test_op11_query(spark):
    library = Tokenizer.from_file(TOKENS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_transducer_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- conversations -----------------------------------------------------------

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows: list[tuple[str, bool, int]]) -> tuple[int, str]:
    """Cost and least script for rows of (initial, must go, truncated), by trying all edits."""
    best, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, script, i, p = heappop(heap)
        if (i, p) in best:
            continue
        best[i, p] = cost, script
        ways = [(2, "I", i, STEP[p].get(r)) for r in "ua"]
        if i < len(rows):
            initial, gone, cut = rows[i]
            ways.append((3, "D", i + 1, p))
            if not gone:
                ways += [(cut, "K", i + 1, STEP[p].get(initial))] + [(2 + cut, "R", i + 1, STEP[p].get(r)) for r in "ua"]
        for c, x, j, q in ways:
            if q is not None:
                heappush(heap, (cost + c, script + x, j, q))
    return min(best[len(rows), p] for p in (0, 3) if (len(rows), p) in best)


def brute_conversations(rows) -> dict:
    """The contract of op12, row by row."""
    def said(x):
        return " " if x is None else str(x)
    out, per = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        per[conv]
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        per[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, kept in per.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, count = set(), [], Counter()
        for turn, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        turns = [t for t, _, _ in kept if t is not None]
        cost, script = cheapest(kinds)
        given, i, odd, n = [], 0, len(script.replace("D", "")) % 2, 0
        for x in script:
            role = kept[i][1] if x == "K" else ("user", "assistant")[(n + odd) % 2]
            if x != "D":
                given.append(f"{role}:{'' if x == 'I' else kept[i][2]}")
                n += 1
            i += x != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
                     illegal, cost, script, hashlib.sha256("\n".join(given).encode()).hexdigest())
    return out


def talks(rng: random.Random, convs: int) -> list[tuple]:
    rows = []
    for c in range(convs):
        for t in range(rng.choice((0, 1, 2, 5, 9, 14))):
            turn = rng.choice((t, t, t, t, None, t + 3))
            text = rng.choice(("Yes.", "No!", "and so on", "", " \t", None, "Same text.", f"Text {rng.randrange(9)}?"))
            rows.append((rng.choice((c, c, c, None)), turn, rng.choice(("system", "user", "user", "assistant", "assistant", "tool", "", None, "admin")), text))
    return rows + rows[:20]


TALK = "conv_id long, turn int, role string, text string, own string"


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame([r + ("own",) for r in rows], TALK).withColumnRenamed("own", "fault").repartition(parts)
    got = conversation.summary(conversation.repair(conversation.damaged(df))).collect()
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_scripts_of_every_short_conversation():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice("suuaax"), rng.random() < .15, int(rng.random() < .3)) for _ in range(rng.randrange(0, 9))]
        state, marks = 0, bytearray()
        for initial, gone, cut in rows:
            code = state * conversation.KINDS + (conversation.MUST_GO if gone else "suax".index(initial) * 2 + cut)
            marks.append(conversation.MACHINE.pointer[code])
            state = conversation.MACHINE.after[code]
        script = conversation._List()
        tail = conversation.spell([bytes(marks)], conversation._List(), script, state)
        assert script[0].decode() + tail == cheapest(rows)[1], rows


def test_conversations_against_brute_force(spark, monkeypatch):
    rows = talks(random.Random(8), 60)
    rows += [(1000, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"Row {t % 90}{'.' if t % 5 else ''}") for t in range(3000)]
    want = {c: x for c, x in brute_conversations(rows).items()}
    got = repaired(spark, rows)
    assert got == {c: x for c, x in want.items() if c in got}
    assert all(want[c][5] == 0 and want[c][6] == "" for c in set(want) - set(got))
    # a conversation over many batches
    monkeypatch.setattr(conversation, "KEEP_BYTES", 5000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert repaired(spark, rows) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_giant_conversation_spills(tmp_path, monkeypatch):
    """Rows and backpointers over the bound go to files, which are gone in the end."""
    monkeypatch.setattr(conversation, "KEEP_BYTES", 2000)
    monkeypatch.setattr(conversation, "PIECE", 500)
    rng = random.Random(3)
    kinds = [(rng.choice("sua?"), rng.random() < .1, int(rng.random() < .2)) for _ in range(900)]
    role = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    table = pa.table({"conv_id": pa.array([5] * 900 + [6], pa.int64()), "turn": pa.array([*range(900), 0], pa.int64()),
                      "role": pa.array([role[k[0]] for k in kinds] + ["user"]), "text": pa.array([f"text {i}" for i in range(901)]),
                      "key": pa.array([str(i).encode() for i in range(901)], pa.binary()),
                      "fault": pa.array(["blank" if g else "truncated" if c else None for _, g, c in kinds] + [None], pa.string()),
                      "kind": pa.array(["sua?".index(x) * 2 + c for x, _, c in kinds] + [2], pa.int32())})
    folder = tmp_path / "spill"
    put = conversation._Pieces.add
    most = []
    monkeypatch.setattr(conversation._Pieces, "add", lambda self, data: (put(self, data), most.append(len(list(folder.iterdir())) if folder.exists() else 0)))
    out = pa.Table.from_batches(list(conversation._stream(f"file://{folder}")(iter(table.to_batches(max_chunksize=50)))))
    assert max(most) > 3 and list(folder.iterdir()) == []
    first = out.filter(pa.compute.equal(out["conv_id"], 5))
    assert "".join(first["edit"].to_pylist()) == cheapest(kinds)[1] and first["pos"].to_pylist() == list(range(len(first)))
    assert out.filter(pa.compute.equal(out["conv_id"], 6))["edit"].to_pylist() == ["K", "I"]
    given = [r[0] for r in first["role"].to_pylist() if r]
    assert re.fullmatch("s?(ua)+", "".join(given))


def test_no_conversations(spark):
    assert repaired(spark, []) == {}


# --- divergence --------------------------------------------------------------

def brute_divergence(rows, min_docs: int, top: int) -> set[tuple]:
    docs = []
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, w in docs if x == lang for t in set(w))
        kept = [t for t, n in held.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for x, s, w in docs:
            if x == lang:
                counts[s].update(t for t in w if held[t] >= min_docs)
        v = len(kept)

        def p(count):
            n = sum(count.values())
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}
        q = p(sum(counts.values(), Counter()))
        each = {s: p(c) for s, c in counts.items()}
        for s in counts:
            pair = sorted((-sum((each[s][t] - each[o][t]) ** 2 // (each[s][t] + each[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            term = sorted((-((each[s][t] - q[t]) ** 2 // (each[s][t] + q[t])), t.encode()) for t in kept if counts[s][t] and each[s][t] > q[t])
            for part, found in (("pair", pair), ("term", term[:top])):
                out |= {(lang, s, part, item.decode(), -value, r + 1) for r, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("tile, cells", [(64, 100_000), (2, 30)])
def test_divergence_against_brute_force(spark, odd, monkeypatch, tile, cells):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    rng = random.Random(6)
    rows = [(rng.choice(("en", "de", None, "")), rng.choice(("a", "b", "c", "Z", "é", None, "")), " ".join(rng.choice(("The", "the", "été", "x1y", "Zed", "own", "w" * 50))
             + rng.choice("ab ") for _ in range(rng.randrange(30)))) for _ in range(150)]
    rows += [("xx", "only", "some words"), ("yy", "one", None), ("yy", "two", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("p", F.lit("own")).withColumn("term", F.lit(1))
    for min_docs, top in ((10, 10), (1, 3)):
        got = divergence.audit(df, min_docs=min_docs, top=top).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows, min_docs, top)
    if tile == 64:
        whole = [(r.lang, r.source, r.text) for r in odd.collect()]
        assert {tuple(r) for r in divergence.audit(odd, min_docs=2).collect()} == brute_divergence(whole, 2, 10)


def test_divergence_of_nothing(spark, no_docs):
    assert divergence.audit(no_docs).collect() == []


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    """Also when two words have one hash, counts are by letters."""
    texts = pa.array([b"ab ba ab", b"ba AB c", b""], pa.binary())
    (_, _, buf, off), = divergence.tx.texts(texts)
    plain = sorted(zip(*divergence.stretch_counts(buf, off, np.array([0, 1, 1]))))
    words = divergence.tx.words
    monkeypatch.setattr(divergence.tx, "words", lambda *a: (lambda s, e, h, f: (s, e, np.zeros_like(h), f))(*words(*a)))
    assert sorted(zip(*divergence.stretch_counts(buf, off, np.array([0, 1, 1])))) == plain == [
        (0, b"ab", 2, 1), (0, b"ba", 1, 1), (1, b"ab", 1, 1), (1, b"ba", 1, 1), (1, b"c", 1, 1)]


