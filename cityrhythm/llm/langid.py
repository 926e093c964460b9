"""Language identification with segmentation-marginalised unigram models.

A fixed public vocabulary of pieces (with one piece for every byte, so any
word can be written) has its own probabilities in each language. The
probability of a word is the sum over all its segmentations into pieces, by a
forward recursion over its bytes; a text is the product of its words, and the
language with the largest posterior wins. The probabilities come from
expectation-maximisation: the forward and backward sums give each piece's
expected count over the corpus's words.

Words repeat, so training runs over the table of distinct words with their
counts in each language, and prediction remembers a bounded number of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .store import materialise

U64 = np.uint64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A longer run of letters is taken as several words of so many bytes.
WORD_BYTES = 256
#: Languages that a model may have: it bounds what is broadcast and sent to the driver.
MAX_LANGUAGES = 400
#: Words with their counts or scores that a task holds at a time.
REMEMBERED = 250_000
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                          T.StructField("lang_fit", T.DoubleType()), T.StructField("lang_bytes", T.LongType())])
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


class Vocabulary:
    """Pieces as byte strings, found by a hash table for many places at once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {bytes([b]): b for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                p = sp.id_to_piece(i).encode()
                if "▁▁".encode() not in p:
                    pieces.setdefault(p, len(pieces))
        self.size = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        self.keys, self.ids = np.zeros(SLOTS, U64), np.full(SLOTS, self.size, np.int32)
        for n in self.lengths:
            own = [(p, k) for p, k in pieces.items() if len(p) == n]
            flat = np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, n)
            hashes = self.hashes(self.sums(flat), n)[0]
            for x, slot, (_, k) in zip(hashes, self.slots(hashes).tolist(), own):
                while self.keys[slot]:
                    slot = (slot + 1) % SLOTS
                self.keys[slot], self.ids[slot] = x, k

    @staticmethod
    def sums(words: np.ndarray) -> np.ndarray:
        """Running polynomial sums of words of one length: a row for each place, a column for each word."""
        rows, n = words.shape
        h = np.zeros((n + 1, rows), U64)
        np.cumsum(tx.BYTE_EXACT[words.T] * tx.powers(n)[0][:n, None], axis=0, dtype=U64, out=h[1:])
        return h

    @staticmethod
    def hashes(sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes at every place."""
        n = len(sums) - size
        return (sums[size:] - sums[:-size]) * tx.powers(n)[1][:n, None] + U64(size * 0xD6E8FEB86659FD93 % 2**64)

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - SLOT_BITS)).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``size`` where there is none."""
        flat = h.ravel()
        s = self.slots(flat)
        k = self.keys[s]
        out = np.full(len(flat), self.size, np.int32)
        hit = np.flatnonzero(k == flat)
        out[hit] = self.ids[s[hit]]
        on = np.flatnonzero((k != 0) & (k != flat))
        s = s[on]
        while len(on):
            s = (s + 1) % SLOTS
            k = self.keys[s]
            hit = k == flat[on]
            out[on[hit]] = self.ids[s[hit]]
            more = (k != 0) & ~hit
            on, s = on[more], s[more]
        return out.reshape(h.shape)

    def edges(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end, the (length, piece numbers) of pieces that end there, for words of one length."""
        n = words.shape[1]
        sums = self.sums(words)
        out: list[list] = [[] for _ in range(n + 1)]
        for size in self.lengths:
            if size > n:
                break
            ids = self.find(self.hashes(sums, size))
            for start in np.flatnonzero((ids < self.size).any(axis=1)).tolist():
                out[start + size].append((size, ids[start]))
        return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their bytes, a row each."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts):
        n = size[group[0]]
        for i in range(0, len(group), 4096):
            part = group[i:i + 4096]
            yield part, np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), n)


def word_scores(vocab: Vocabulary, words: list[bytes], prob: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language, over all segmentations.

    ``prob``: piece by language, with a last row of zeros.
    """
    out = np.empty((len(words), prob.shape[1]))
    for part, rows in by_length(words):
        n = rows.shape[1]
        alpha = np.zeros((n + 1, len(part), prob.shape[1]))
        alpha[0], log = 1, np.zeros((len(part), prob.shape[1]))
        for end, into in enumerate(vocab.edges(rows)):
            for size, ids in into:
                alpha[end] += alpha[end - size] * prob[ids]
            if end and end % 16 == 0:      # sums that later ends need are kept in range
                top = alpha[end].copy()
                alpha[max(0, end - vocab.lengths[-1]):end + 1] /= top
                log += np.log(top)
        out[part] = np.log(alpha[n]) + log
    return out


def expected(vocab: Vocabulary, words: list[bytes], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece in words with these counts, under one language's probabilities.

    Forward and backward sums are kept in range by one factor a place, the
    forward sum there, so that every product of the three is a probability.
    """
    total = np.zeros(vocab.size + 1)
    for part, rows in by_length(words):
        n = rows.shape[1]
        into = [[(size, ids, prob[ids]) for size, ids in e] for e in vocab.edges(rows)]
        wide = vocab.lengths[-1]
        # alpha[e] is divided by the product of scale[1..e]; scale[e] makes it 1
        alpha, scale = np.zeros((n + 1, len(part))), np.ones((n + 1, len(part)))
        alpha[0] = 1
        for end in range(1, n + 1):
            reach, own = np.ones(len(part)), np.zeros(len(part))
            by_size = {size: p for size, _, p in into[end]}
            for size in range(1, min(end, wide) + 1):
                if size in by_size:     # alpha[end - size] in the scale of end - 1
                    own += alpha[end - size] * by_size[size] * reach
                reach = reach / scale[end - size]
            scale[end] = own
            alpha[end] = 1
        beta = np.zeros((n + 1, len(part)))
        beta[n] = 1
        weight = counts[part]
        for end in range(n, 0, -1):
            reach = 1 / scale[end]
            by_size = {size: (ids, p) for size, ids, p in into[end]}
            for size in range(1, min(end, wide) + 1):
                if size in by_size:
                    ids, p = by_size[size]
                    flow = p * reach * beta[end]
                    beta[end - size] += flow
                    total += np.bincount(ids, flow * weight * alpha[end - size], vocab.size + 1)
                if end - size > 0:
                    reach = reach / scale[end - size]
    return total[:-1]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def as_bytes(word: str) -> list[bytes]:
    """A word with its mark of a beginning, cut where it is too long."""
    b = ("▁" + word).encode("utf-8", "surrogatepass")
    return [b] if len(b) <= WORD_BYTES else [b[i:i + WORD_BYTES] for i in range(0, len(b), WORD_BYTES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, word, n."""
    def rows(of: dict[str, Counter]) -> pa.RecordBatch:
        lang, word, n = [], [], []
        for x, c in of.items():
            for w, k in c.items():
                for b in as_bytes(w):
                    lang.append(x)
                    word.append(b)
                    n.append(k)
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    of: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            of.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, of.values())) > REMEMBERED:
            yield rows(of)
            of = {}
    yield rows(of)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Model:
    """Languages, their log priors, and the pieces' probabilities by language."""

    def __init__(self, path: str, languages: list[str], prior: np.ndarray, prob: np.ndarray):
        self.path, self.languages, self.prior, self.prob = path, languages, prior, prob


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, rounds: int = 2,
        smooth: float = 0.1) -> Model:
    """Fit a model on all rows with a text and a language.

    ``rounds`` of expectation-maximisation from equal probabilities, each piece's
    expected count raised by ``smooth``. Only counts by language, and by language
    and piece, reach the driver.
    """
    spark = docs.sparkSession
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = src.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in rows)
    vocab = Vocabulary(path)
    prob = np.zeros((vocab.size + 1, len(langs)))
    prob[:-1] = 1 / vocab.size
    if not langs:
        return Model(path, langs, np.zeros(0), prob)
    n = {r["lang"]: r["n"] for r in rows}
    prior = np.log(np.array([n[x] for x in langs]) / sum(n.values()))
    words = materialise(src.mapInArrow(tx.trimmed(_counted), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, sums = vocabulary(path), {}
            for batch in batches:
                lang = np.array(batch["lang"].to_pylist(), object)
                word, n = batch["word"].to_pylist(), batch["n"].to_numpy()
                for x in set(lang):
                    at = np.flatnonzero(lang == x)
                    got = expected(v, [word[i] for i in at], n[at], now.value[:, langs.index(x)])
                    sums[x] = sums.get(x, 0) + got
            for x, s in sums.items():
                k = np.flatnonzero(s)
                yield pa.record_batch([pa.array([x] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(s[k])], names=["lang", "piece", "n"])

        got = words.mapInArrow(tx.trimmed(gather), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        count = np.full((vocab.size, len(langs)), smooth)
        place = {x: i for i, x in enumerate(langs)}
        count[got["piece"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
        prob = np.vstack([count / count.sum(axis=0), np.zeros(len(langs))])
    return Model(path, langs, prior, prob)


def _predicted(model, column: str, names: list[str]):
    """Batches -> the same with the columns of ``names`` out of lang_pred, score, lang_fit and lang_bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        v = vocabulary(m.path)
        known: dict[str, int] = {}
        scores, sizes = np.zeros((0, len(m.languages))), np.zeros(0, np.int64)
        for batch in batches:
            lang, score, fit, size = [], [], [], []
            texts = batch[column].to_pylist()
            for a in range(0, len(texts), 500):
                docs = [words_of(t) if t and m.languages and _LETTER.search(t) else [] for t in texts[a:a + 500]]
                if len(known) > REMEMBERED:
                    known, scores, sizes = {}, scores[:0], sizes[:0]
                new = list(set().union(*docs) - known.keys())
                if new:
                    parts = [as_bytes(w) for w in new]
                    flat = word_scores(v, [b for p in parts for b in p], m.prob)
                    if len(flat) > len(parts):
                        flat = np.add.reduceat(flat, np.cumsum([0] + [len(p) for p in parts])[:-1], axis=0)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    scores = np.vstack([scores, flat])
                    sizes = np.append(sizes, [sum(map(len, p)) for p in parts])
                for words in docs:
                    if not words:
                        lang.append("und")
                        score.append(0.0)
                        fit.append(None)
                        size.append(0)
                        continue
                    at = [known[w] for w in words]
                    own = scores[at].sum(axis=0)
                    s = m.prior + own
                    best = int(s.argmax())
                    size.append(int(sizes[at].sum()))
                    fit.append(float(own[best]) / size[-1])
                    lang.append(m.languages[best])
                    score.append(float(1 / np.exp(s - s[best]).sum()))
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64()), pa.array(size, pa.int64())]
            yield pa.record_batch([*batch.columns, *new[:len(names)]], names=[*batch.schema.names, *names])
    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", fit: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and with ``fit`` also lang_fit and lang_bytes (columns of these names are replaced).

    ``score`` is the posterior of the predicted language, ``lang_fit`` the mean
    log probability of a byte of the text's words in it (null without words) and
    ``lang_bytes`` the number of these bytes. Texts that are null or
    without any letter, and all texts where the model has no language, are
    ``und`` with score 0. Ties go to the language that sorts first.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)
    fields = PREDICTED.fields if fit else PREDICTED.fields[:2]
    names = [f.name for f in fields]
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    return src.mapInArrow(tx.trimmed(_predicted(b, text_col, names)), T.StructType([*src.schema.fields, *fields]))


def unlike(predicted: DataFrame, lang_col: str = "lang", spreads: float = 12.0) -> DataFrame:
    """``predicted`` (of ``predict`` with ``fit``) with unlike: whether the text is far from all that the language's own texts are.

    A language's own texts are those labelled with it that also got it. A text
    is unlike them when its lang_fit lies more than ``spreads`` standard
    deviations below their mean; the deviation is that of their lang_fit or, for
    short texts, the one that so few bytes have, whichever is larger. It is
    false where there is nothing to compare with. A column of that name is
    replaced; ``predicted`` is read twice, so pass a written table.
    """
    own = predicted.where((F.col(lang_col).cast("string") == F.col("lang_pred")) & F.col("lang_fit").isNotNull())
    mean = own.groupBy("lang_pred").agg(F.avg("lang_fit").alias("_mean"), F.stddev_pop("lang_fit").alias("_dev"),
                                        F.avg(F.col("lang_fit") ** 2 * F.col("lang_bytes")).alias("_xx"),
                                        F.avg(F.col("lang_fit") * F.col("lang_bytes")).alias("_x"), F.avg("lang_bytes").alias("_n"))
    a_byte = F.greatest(F.lit(0.0), F.col("_xx") - 2 * F.col("_mean") * F.col("_x") + F.col("_mean") ** 2 * F.col("_n"))
    known = mean.select(F.col("lang_pred").alias("_lang"), "_mean", "_dev", a_byte.alias("_a_byte"))
    least = F.col("_mean") - spreads * F.greatest("_dev", F.sqrt(F.col("_a_byte") / F.greatest("lang_bytes", F.lit(1))))
    kept = [F.col(f"`{c}`") for c in predicted.columns if c.lower() != "unlike"]
    return predicted.join(known, F.col("lang_pred") == F.col("_lang"), "left").select(
        *kept, F.coalesce(F.col("lang_fit") < least, F.lit(False)).alias("unlike"))


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; false for null ids."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 4 == 2, F.lit(False))
