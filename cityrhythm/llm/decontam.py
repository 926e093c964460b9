"""Benchmark passages in documents: a prefix-filtered join on word windows.

A document holds a window of an item only if it holds every shingle of it, so
one shingle is a sufficient prefix: the one that the corpus has least often.
Documents are searched for these rarest shingles only; each place found is a
candidate for the windows with that prefix, subject to its position and the
document's length, and is confirmed by comparing all words of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from . import text as tx
from .store import materialise

U64 = np.uint64
SHINGLE = 3
#: Places of shingles that are handed on together at most; it bounds memory alone.
CHUNK = 16_384
_COLUMNS = ["id", "row_key", "n_words", "token", "inside", "around", "places"]


def _windows(window: int):
    """Items -> a row for each window and shingle in it."""
    names = ["item", "window", "words", "offset", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            items = batch["item"].to_pylist()
            for a, b, buf, off in tx.texts(batch["text"]):
                s, e, h, first = tx.words(buf, off, tx.ALNUM)
                low = tx._LOWER[buf]
                w = [low[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist())]
                for r in range(b - a):
                    n = int(first[r + 1] - first[r])
                    size = min(window, n)
                    k = min(SHINGLE, size)
                    for p in range(first[r], first[r] + n - size + 1) if n else ():
                        text = b" ".join(w[p:p + size])
                        rows.extend((items[a + r], text, size, i, int(t)) for i, t in
                                    enumerate(tx.joined(h[p:p + size], k).view(np.int64)))
            yield pa.record_batch([pa.array([x[i] for x in rows], kind) for i, kind in
                                   enumerate((batch["item"].type, pa.binary(), pa.int32(), pa.int32(), pa.int64()))],
                                  names=names)
    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch["token"].to_numpy().view(U64)


def found(h: np.ndarray, first: np.ndarray, sizes: list[int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the shingles of these sizes that the bitmap has, and their hashes."""
    at, hits = [], []
    for k in sizes:
        sh, i = tx.shingles(h, first, k, short=False)
        ok = bloom.has(wanted, sh)
        at.append(i[ok])
        hits.append(sh[ok])
    return (np.concatenate(at), np.concatenate(hits)) if at else (np.zeros(0, np.int64), np.zeros(0, U64))


def _counts(wanted, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.zeros(0, U64)]
            for _, _, buf, off in tx.texts(batch["text"]):
                _, _, h, first = tx.words(buf, off, tx.ALNUM)
                hits.append(found(h, first, sizes, wanted.value)[1])
            u, n = np.unique(np.concatenate(hits), return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])
    return run


def _gathered(low: np.ndarray, s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """For each run of words lo..hi the list of its words, as bytes."""
    n = hi - lo
    ends = np.cumsum(n)
    w = np.arange(n.sum()) + np.repeat(lo - (ends - n), n)
    size = e[w] - s[w]
    stop = np.cumsum(size)
    data = low[np.arange(size.sum()) + np.repeat(s[w] - (stop - size), size)]
    words = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words)


def _places(wanted, sizes: list[int], window: int):
    """Texts -> a row with n_words for each, and rows of places.

    A row of places is a shingle with the words around it that a window may
    need (none for items shorter than the shingle) and all word indices of one
    chunk of places with these same words: a text that repeats itself gives a
    few rows, and no chunk holds more than ``CHUNK`` places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = []
            for a, b, buf, off in tx.texts(batch["text"]):
                s, e, h, first = tx.words(buf, off, tx.ALNUM)
                n_words.append(np.diff(first))
                low = tx._LOWER[buf]
                for k in sizes:
                    all_at, all_hits = found(h, first, [k], wanted.value)
                    back, ahead = (0, k) if k < SHINGLE else (window - k, window)
                    for c in range(0, len(all_at), CHUNK):
                        at, hits = all_at[c:c + CHUNK], all_hits[c:c + CHUNK]
                        row = np.searchsorted(first, at, "right") - 1
                        lo, hi = np.maximum(first[row], at - back), np.minimum(first[row + 1], at + ahead)
                        key = tx.mix(row.astype(U64) * U64(4 * window * window) + (at - lo).astype(U64) * U64(2 * window) + (hi - at).astype(U64))
                        for j in range(back + ahead):
                            inside = lo + j < hi
                            key[inside] = tx.mix(key[inside] + h[lo[inside] + j])
                        _, rep, group = np.unique(key, return_index=True, return_inverse=True)
                        order = np.argsort(group, kind="stable")
                        stops = np.append(0, np.cumsum(np.bincount(group, minlength=len(rep))))
                        owner = pa.array(a + row[rep])
                        yield pa.record_batch(
                            [batch["id"].take(owner), batch["row_key"].take(owner), pa.nulls(len(rep), pa.int64()),
                             pa.array(hits[rep].view(np.int64)), pa.array((at - lo)[rep].astype(np.int32)),
                             _gathered(low, s, e, lo[rep], hi[rep]),
                             pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array((at - first[row])[order], pa.int64()))],
                            names=_COLUMNS)
            n = len(batch)
            yield pa.record_batch([batch["id"], batch["row_key"], pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                                   pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.binary())),
                                   pa.nulls(n, pa.list_(pa.int64()))], names=_COLUMNS)
    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: id_col, row_key, n_words, n_hit, n_items, items, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A
    window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. A document's word inside any occurrence of a
    window is hit; ``items`` are the ids (as strings, sorted) of the items with
    an occurring window. Null, empty and wordless texts have no words and no
    hits; items with a null id take no part, repeated items count once. Very
    long and repetitive texts are searched in bounded chunks; either table may
    be empty, and columns besides the named ones are not read. Within a chunk,
    words are taken for the same by their 64-bit hashes.
    """
    src = docs.select(F.col(id_col).alias("id"), tx.row_key(docs, id_col, text_col).alias("row_key"),
                      F.col(text_col).cast("binary").alias("text"))
    it = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text"))
    kind = it.schema["item"].dataType.simpleString()
    parts = materialise(it.mapInArrow(_windows(window), f"item {kind}, window binary, words int, offset int, token long"), "windows")
    sizes = sorted(min(SHINGLE, r[0]) for r in parts.select(F.least("words", F.lit(SHINGLE))).distinct().collect())
    bits = bloom.bits_for(parts.count())
    # how often the corpus has each shingle of the benchmark
    wanted = bloom.filters(parts.select("token"), _tokens, bits, seen=1)
    often = src.mapInArrow(tx.trimmed(_counts(wanted, sizes)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # the prefix of each window; a window with a shingle that the corpus lacks occurs nowhere
    prefix = materialise(
        parts.select("window", "words", "offset", "token").distinct().join(often, "token", "left")
        .groupBy("window", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("p"))
        .where("p.n > 0").select("window", "words", "p.offset", "p.token"), "prefix")
    wanted = bloom.filters(prefix.select("token"), _tokens, bits, seen=1)
    doc_kind = src.schema["id"].dataType.simpleString()
    rows = materialise(src.mapInArrow(
        tx.trimmed(_places(wanted, sizes, window)), f"id {doc_kind}, row_key long, n_words long, token long, inside int, "
        "around array<binary>, places array<long>"), "places")
    start = F.col("inside") - F.col("offset")
    hits = (rows.where("token is not null").select("id", "row_key", "token", "inside", "around", "places").join(prefix, "token")
            .where((start >= 0) & (start + F.col("words") <= F.size("around")))
            .where(F.concat_ws(" ", F.transform(F.slice("around", start + 1, F.col("words")), lambda x: x.cast("string"))).cast("binary")
                   == F.col("window"))
            .select("id", "row_key", "offset", "words", "window", "places"))
    hits = materialise(hits, "hits")
    # the union of a text's spans as rows: a running end, sorted and spilled by Spark, whatever their number
    first = F.col("at") - F.col("offset")
    spans = (hits.select("id", "row_key", "offset", "words", F.explode("places").alias("at"))
             .groupBy("id", "row_key", first.alias("start")).agg(F.max(first + F.col("words")).alias("stop")))
    before = Window.partitionBy("id", "row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (spans.withColumn("upto", F.max("stop").over(before))
               .groupBy("id", "row_key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("upto", "start")))).alias("n_hit")))
    named = (hits.select("id", "row_key", "window").distinct().join(parts.select("window", "item").distinct(), "window")
             .groupBy("id", "row_key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")))
    hit = (covered.join(named.withColumnsRenamed({"id": "i2", "row_key": "k2"}),
                      F.col("id").eqNullSafe(F.col("i2")) & (F.col("row_key") == F.col("k2")))
           .select(F.col("id").alias("i1"), F.col("row_key").alias("k1"), "n_hit", "items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.where("token is null").select("id", "row_key", "n_words").join(hit, F.col("id").eqNullSafe(F.col("i1")) & (F.col("row_key") == F.col("k1")), "left")
            .select(F.col("id").alias(id_col), "row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"), items.alias("items"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
