"""BPE encoding with a memory-mapped lexicon of frequent words, and decoding.

A text's tokens are those of its words (runs without white space) one behind
another. The corpus's frequent words are counted, encoded once by the merges
and compiled into a minimal acyclic transducer whose outputs are the ids. The
file goes to the shared work folder, Spark hands it to every executor (also to
those started later), and tasks map it into memory. Words that the lexicon
lacks are split and merged exactly, whatever their length; so the lexicon
decides on speed alone, never on the result.

For files of the tokenizers library with byte-level BPE, word ends and a
pattern that drops white space. Its own normalizer and splitter are used for
unseen words; the merges are done here.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import text as tx
from . import transducer
from .store import materialise, new_path

#: Words of the lexicon at most, and bytes of one; those it lacks are merged.
LEXICON_WORDS, WORD_BYTES = 65_536, 64
#: Distinct words that a task counts before it starts anew.
COUNTED = 200_000
#: Symbols up to which words are merged together, words that are so at a time, and letters up to which they are split together.
SHORT, ROWS, PLAIN = 64, 1 << 14, 256
NONE = 1 << 62
#: White space that words may hold, as only ASCII's ends them.
_ODD = re.compile(r"[^\S \t\n\x0b\x0c\r]")
#: Characters of a word from which it is split in parts before it is normalised.
LONG_WORD = 1 << 16
# Fixed value: the pattern whose pieces don't reach over white space or the places of _CUT.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where such a pattern always starts a new piece and nothing is composed: an ASCII character follows a digit, or kinds change.
_CUT = re.compile(r"(?<=[0-9])(?=[!-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~])")


def model_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The merges and tokens of a tokenizer's file as arrays, and what splits a text into pieces."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    m, pre = j["model"], j.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    split = [s for s in steps if s["type"] == "Split"]
    plain = (m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
             and j.get("decoder") is None and [s["type"] for s in steps] == ["Split", "ByteLevel"]
             and split[0]["pattern"] == {"Regex": _PATTERN} and split[0]["invert"] and split[0]["behavior"] == "Removed"
             and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
             and not any(a[k] for a in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
             and not any(re.search(r"\s", a["content"]) for a in j["added_tokens"]))
    if not plain:
        raise ValueError(f"{path} is of another kind than byte-level BPE with word ends that drops white space")
    vocab, end = m["vocab"], m.get("end_of_word_suffix") or ""
    alphabet = sorted({c for t in vocab for c in t.removesuffix(end)})
    inner = [vocab.get(c, -1) for c in alphabet]
    last = [vocab.get(c + end, -1) for c in alphabet]
    if len(alphabet) != 256 or min(inner + last) < 0:
        raise ValueError(f"{path} lacks bytes")
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    values = np.array([r << 32 | vocab[a + b] for r, (a, b) in enumerate(merges)], np.int64)
    order = np.argsort(keys)
    tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in j["added_tokens"]}
    names = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
    arrays = {"keys": keys[order], "values": values[order], "names": np.frombuffer(b"".join(names), np.uint8),
              "name_at": np.cumsum([0] + [len(x) for x in names]), "known": np.array([i in tokens for i in range(len(names))], np.uint8)}
    tool = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": j["normalizer"],
            "pre_tokenizer": pre, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
    return arrays, {"tool": json.dumps(tool), "alphabet": "".join(alphabet), "inner": inner, "last": last,
                    "special": {a["content"]: a["id"] for a in j["added_tokens"]}}


class Encoder:
    """Encodes and decodes with the arrays of a lexicon's file (or those of a model alone)."""

    def __init__(self, arrays: dict[str, np.ndarray], more: dict):
        self.arrays = arrays
        self.has_words = "base" in arrays
        self.tool = Tokenizer.from_str(more["tool"])
        self.inner, self.last = (np.full(max(map(ord, more["alphabet"])) + 1, -1, np.int64) for _ in range(2))
        for c, i, j in zip(more["alphabet"], more["inner"], more["last"]):
            self.inner[ord(c)], self.last[ord(c)] = i, j
        self.special = more["special"]
        names = sorted(self.special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merge_many(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short words (their symbols one behind another, and their lengths) a merge each at a time.

        Always the pair of the lowest rank, the leftmost of equal ones first, until a word has none.
        """
        first = np.cumsum(size) - size
        left = size.copy()
        out = sym.copy()
        width = 2
        while width < 2 * SHORT:
            rows = np.flatnonzero((size >= width) & (size < 2 * width))
            most = min(2 * width - 1, SHORT)
            width *= 2
            for a in range(0, len(rows), ROWS):
                some = rows[a:a + ROWS]
                at = np.arange(most)
                m = np.where(at < size[some, None], sym[np.minimum(first[some, None] + at, len(sym) - 1)], -1)
                v = self.look(m[:, :-1], m[:, 1:])
                while len(some):
                    best = v.argmin(axis=1)
                    got = v[np.arange(len(some)), best]
                    done = got == NONE
                    if done.any():
                        n = (m[done] >= 0).sum(axis=1)
                        left[some[done]] = n
                        for k in range(int(n.max())):
                            has = n > k
                            out[first[some[done]][has] + k] = m[done, k][has]
                        m, v, some, best, got = m[~done], v[~done], some[~done], best[~done], got[~done]
                        if not len(some):
                            break
                    i = np.arange(len(some))
                    take = at[:-1] + (at[:-1] > best[:, None])      # all columns but the one behind the best
                    m = np.take_along_axis(m, take, axis=1)
                    m[i, best] = got & 0xFFFFFFFF
                    v = np.take_along_axis(v, np.minimum(take[:, :-1], v.shape[1] - 1), axis=1)
                    at = at[:-1]
                    for c in (best - 1, best):
                        ok = (c >= 0) & (c < v.shape[1])
                        v[i[ok], c[ok]] = self.look(m[i[ok], c[ok]], m[i[ok], c[ok] + 1])
                    if v.shape[1] == 0:
                        left[some] = 1
                        out[first[some]] = m[:, 0]
                        break
        keep = np.arange(len(sym)) - np.repeat(first, size) < np.repeat(left, size)
        return out[keep].astype(np.int32), left

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merges of pairs, as rank and new symbol, or NONE."""
        keys, values = self.arrays["keys"], self.arrays["values"]
        key = np.where(b < 0, -1, a << 32 | b)
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[k] == key, values[k], NONE)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for a word of any length: all places of a pair at once, the pairs by rank."""
        n = len(ids)
        sym = ids.astype(np.int64)
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[right[at] < n]
            v = self.look(sym[at], sym[right[at]])
            at, v = at[v != NONE], v[v != NONE]
            order = np.argsort(v, kind="stable")
            at, v = at[order], v[order]
            cuts = np.flatnonzero(np.diff(v)) + 1
            for part, first in zip(np.split(at, cuts), np.concatenate([[0], cuts]) if len(v) else []):
                x = int(v[first])
                if x not in waiting:
                    heapq.heappush(ranks, x)
                waiting.setdefault(x, []).append(part)

        for a in range(0, n, 1 << 20):
            wait(np.arange(a, min(a + (1 << 20), n), dtype=np.int32))
        while ranks:
            v = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(v)))
            at = at[(sym[at] >= 0) & (right[at] < n)]
            at = at[self.look(sym[at], sym[right[at]]) == v]
            if not len(at):
                continue
            if sym[at[0]] == sym[right[at[0]]]:     # in a run every second place, from the left
                chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = right[at]
            behind = right[gone]
            sym[at], sym[gone], right[at] = v & 0xFFFFFFFF, -1, behind
            inside = behind < n
            left[behind[inside]] = at[inside]
            before = left[at]
            wait(np.unique(np.concatenate([at, before[before >= 0]])))
        return sym[sym >= 0].astype(np.int32)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one behind another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(size):
            return np.zeros(0, np.int32), size
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        sym = self.inner[chars]
        sym[np.cumsum(size) - 1] = self.last[chars[np.cumsum(size) - 1]]
        if not (size > SHORT).any():
            return self.merge_many(sym, size)
        out, counts = [], np.zeros(len(pieces), np.int64)
        cuts = np.flatnonzero(size > SHORT)
        at = np.concatenate([[0], np.cumsum(size)])
        for a, b in zip(np.concatenate([[0], cuts + 1]), np.append(cuts, len(pieces))):    # the short ones before a long one, and that
            ids, counts[a:b] = self.merge_many(sym[at[a]:at[b]], size[a:b])
            out.append(ids)
            if b < len(pieces):
                out.append(self.merge_long(sym[at[b]:at[b + 1]]))
                counts[b] = len(out[-1])
        return np.concatenate(out), counts

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without ASCII white space, one behind another, and how many each has.

        Plain words are normalised and split together, others one by one.
        """
        plain = [i for i, w in enumerate(words) if len(w) <= PLAIN and not _ODD.search(w) and not (self.splitter and self.splitter.search(w))]
        normal, split = self.tool.normalizer.normalize_str, self.tool.pre_tokenizer.pre_tokenize_str
        text = normal(" ".join(words[i] for i in plain)) if plain else ""
        if text.count(" ") != max(len(plain) - 1, 0):
            plain, text = [], ""
        got = split(text)
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        pieces = [x[0] for x in got]
        of = np.array(plain, np.int64)[np.searchsorted(blanks, np.fromiter((x[1][0] for x in got), np.int64, len(got)))]
        if len(plain) < len(words):
            more, fixed = [], {}
            for i in sorted(set(range(len(words))) - set(plain)):
                for part in self.splitter.split(words[i]) if self.splitter else [words[i]]:
                    if part in self.special:    # a place for its id
                        fixed[len(pieces)] = self.special[part]
                        pieces.append("!")
                        more.append(i)
                        continue
                    for some in self.parts(part):
                        new = [p for p, _ in split(normal(some)) if p]
                        pieces += new
                        more += [i] * len(new)
            of = np.concatenate([of, np.array(more, np.int64)])
            order = np.argsort(of, kind="stable")
            ids, n = self.pieces([pieces[i] for i in order.tolist()])
            if fixed:
                at = np.empty(len(order), np.int64)
                at[order] = np.cumsum(n) - n
                ids[at[list(fixed)]] = list(fixed.values())
            of = of[order]
        else:
            ids, n = self.pieces(pieces)
        return ids, np.bincount(of, n, len(words)).astype(np.int64)

    @staticmethod
    def parts(word: str) -> Iterator[str]:
        """A very long word in parts whose tokens are those of the whole."""
        at = 0
        if len(word) > LONG_WORD:
            for m in _CUT.finditer(word):
                if m.start() - at >= LONG_WORD:
                    yield word[at:m.start()]
                    at = m.start()
        if at < len(word):
            yield word[at:]

    def encode(self, column: pa.Array) -> pa.Array:
        """Each text's ids; null texts have none."""
        values, counts = [], []
        for a, b, buf, off in tx.texts(column):
            starts, ends, first = _words(buf, off)
            size, met = np.full(len(starts), -1, np.int64), []
            short = np.flatnonzero(ends - starts <= WORD_BYTES)
            if self.has_words and len(short):
                size[short], met = transducer.look_up(self.arrays, buf, starts[short], ends[short])
            known = size.copy()
            unseen = np.flatnonzero(size < 0)
            new: dict[bytes, int] = {}
            of = np.array([new.setdefault(buf[x:y].tobytes(), len(new)) for x, y in zip(starts[unseen].tolist(), ends[unseen].tolist())], np.int64)
            ids, counts_new = self.words([w.decode("utf-8", "replace") for w in new])
            size[unseen] = counts_new[of]
            place = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(size, out=place[1:])
            out = np.empty(place[-1], np.int32)
            if met:
                transducer.write_out(self.arrays, met, known[short], place[short], out)
            if len(unseen):
                n = counts_new[of]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(place[unseen], n) + step] = ids[np.repeat((np.cumsum(counts_new) - counts_new)[of], n) + step]
            values.append(out)
            counts.append(np.diff(place[first]))
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ids = np.concatenate(values) if values else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, column: pa.Array) -> pa.Array:
        """The tokens' names, joined by blanks, as the library does without a decoder. Unknown ids are left out."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        t = self.arrays
        out = []
        for ids in column:
            ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
            parts = (self._names(ids[a:a + (1 << 16)], t) for a in range(0, len(ids), 1 << 16))
            out.append(b" ".join(p for p in parts if p))
        return pa.array(out, pa.binary()).cast(pa.string())

    @staticmethod
    def _names(ids: np.ndarray, t: dict[str, np.ndarray]) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(t["known"]))]
        ids = ids[t["known"][ids] > 0]
        if not len(ids):
            return b""
        n = t["name_at"][ids + 1] - t["name_at"][ids] + 1
        stop = np.cumsum(n)
        src = np.arange(stop[-1]) + np.repeat(t["name_at"][ids] - (stop - n), n)
        src[stop - 1] = 0
        out = t["names"][src]
        out[stop - 1] = 32
        return out[:-1].tobytes()


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and each text's first (one more at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    mask = tx.NOT_SPACE[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[off] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | border[1:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | border[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off, "left")


@dataclass(frozen=True)
class Lexicon:
    """A compiled lexicon that Spark hands out under this name."""

    name: str
    words: int


_open: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """The executor's own copy of the file, mapped once a Python worker."""
    if name not in _open:
        _open.clear()
        _open[name] = Encoder(*transducer.load(SparkFiles.get(name)))
    return _open[name]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, buf, off in tx.texts(batch["text"]):
            s, e, _ = _words(buf, off)
            short = e - s <= WORD_BYTES
            s, e = s[short], e[short]
            if not len(s):
                continue
            # a clash of hashes would miscount a word, which here costs speed alone
            _, at, n = np.unique(tx.spans_hash(buf, s, e, tx.BYTE_EXACT), return_index=True, return_counts=True)
            for x, y, k in zip(s[at].tolist(), e[at].tolist(), n.tolist()):
                w = buf[x:y].tobytes()
                counts[w] = counts.get(w, 0) + k
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    yield out()


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words (binary ``word``, ``n``) of all texts: those from the least count on that no more than ``words`` reach.

    Counts of 2 and more in classes of a sixteenth of an octave; words of over 64 bytes take no part.
    """
    src = docs.select(F.col(text_col).cast("binary").alias("text"))
    counts = materialise(src.mapInArrow(tx.trimmed(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
                         .withColumn("class", F.floor(16 * F.log2("n")).cast("int")), "words")
    least, total = None, 0
    for r in sorted(counts.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):   # at most 16 x 64 classes
        total += r.n
        if total > words:
            break
        least = r["class"]
    return counts.where(F.lit(False) if least is None else F.col("class") >= least).select("word", "n")


def compile_lexicon(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> Lexicon:
    """Compile the frequent words of ``docs`` with the tokenizer's file at ``path``, which only the driver reads.

    The lexicon has at most ``words`` words of at most 64 bytes, so its
    compilation on the driver is bounded. It may be empty (an empty table, or
    no word that comes twice).
    """
    arrays, more = model_arrays(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder(arrays, more)
        for b in batches:
            ids, n = model.words([w.decode("utf-8", "replace") for w in b["word"].to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.record_batch([b["word"], pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], names=["word", "ids"])

    rows = frequent_words(docs, text_col, words).select("word").mapInArrow(encode, "word binary, ids array<int>").collect()
    pairs = sorted((bytes(r.word), tuple(r.ids)) for r in rows)
    data = transducer.dump(transducer.pack(transducer.build(pairs)) | arrays, more)
    name = f"lexicon-{uuid.uuid4().hex}"
    uri = f"{new_path(spark, 'lexicon')}/{name}"
    fs, root = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(root, compression=None) as f:
        f.write(data)
    spark.sparkContext.addFile(uri)
    return Lexicon(name, len(pairs))


def encode(text: Column, lexicon: Lexicon) -> Column:
    """The ids (array<int>) of a text column.

    Null and empty texts have an empty array. Texts are encoded whole, each row
    for itself, so repeated rows have equal ids. Special tokens written in a
    text are those tokens, as in the library.
    """
    name = lexicon.name

    def run(column: pa.Array) -> pa.Array:
        return _encoder(name).encode(column)

    # said to be nondeterministic, so that Spark encodes once, however often the ids are used
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text.cast("binary"))


def decode(ids: Column, lexicon: Lexicon) -> Column:
    """The text of an array of ids: the tokens' names joined by blanks, specials included; null and empty arrays give ''."""
    name = lexicon.name

    def run(column: pa.Array) -> pa.Array:
        return _encoder(name).decode(column)

    return F.arrow_udf(run, "string")(ids)


def digest(ids: Column) -> Column:
    """SHA-256 (lower-case hex) of the ids as little-endian unsigned 32-bit integers."""
    def run(column: pa.Array) -> pa.Array:
        import hashlib
        return pa.array([hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() if x.is_valid
                         else hashlib.sha256().hexdigest() for x in column], pa.string())

    return F.arrow_udf(run, "string")(ids)
