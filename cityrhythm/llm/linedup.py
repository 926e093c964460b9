"""Lines that many documents share, kept in one document only.

Two Bloom filters over the lines' hashes find the lines that some second
document has; only those suspects are shuffled, by a SHA-256 of the line, for
the exact count and the choice of the document that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import text as tx
from .store import materialise

_STRIP = b" \t\n\x0b\x0c\r"


def keyed_lines(buf: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines whose key has at least ``min_chars`` code points: text, key's start, key's end, key's hash."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    cut = cut[cut < n]
    start = cut
    stop = np.append(cut[1:], n)
    solid = np.flatnonzero(tx.NOT_SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, stop)
    some = b > a
    start, a, b = start[some], a[some], b[some]
    s, e = solid[a], solid[b - 1] + 1
    chars = np.zeros(n + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    long = chars[e] - chars[s] >= min_chars
    s, e = s[long], e[long]
    return np.searchsorted(off, start[long], "right") - 1, s, e, tx.spans_hash(buf, s, e, tx.BYTE_LOWER)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, buf, off in tx.texts(batch["text"]):
                row, _, _, h = keyed_lines(buf, off, min_chars)
                yield np.unique(np.rec.fromarrays([row, h]))["f1"] if len(h) else h
    return run


def _suspects(seen, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for first, _, buf, off in tx.texts(batch["text"]):
                row, s, e, h = keyed_lines(buf, off, min_chars)
                hit = bloom.has(seen.value, h)
                got = {(r, hashlib.sha256(buf[x:y].tobytes().lower()).digest())
                       for r, x, y in zip(row[hit].tolist(), s[hit].tolist(), e[hit].tolist())}
                at.extend(first + r for r, _ in got)
                keys.extend(k for _, k in got)
            at = pa.array(at, pa.int64())
            yield pa.record_batch([batch["id"].take(at), batch["row_key"].take(at), pa.array(keys, pa.binary())],
                                  names=["id", "row_key", "key"])
    return run


def without(text: bytes | None, drop: set[bytes]) -> tuple[bytes | None, int, int]:
    """The text without the lines whose key's SHA-256 is in ``drop``; lines before, lines dropped."""
    if not text:
        return text, 1, 0
    if not drop:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    kept = [x for x in lines if hashlib.sha256(x.strip(_STRIP).lower()).digest() not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _cleaned(text: pa.Array, drop: pa.Array) -> pa.Array:
    out = [without(t, set(d or ())) for t, d in zip(text.to_pylist(), drop.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in
                                       enumerate((pa.binary(), pa.int64(), pa.int64()))],
                                      names=["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """``docs`` without repeated lines: its columns with the text cleaned, and n_lines, n_dropped.

    Texts are split at newlines; a line's key is the line without white space
    (``[\\x20\\x09-\\x0D]``) at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in ``min_docs`` (2 or more) documents lose
    all their lines but those in the largest id that holds them. A null text
    stays null and, like an empty one, is a single line. Rows are documents: a
    repeated row counts again, and rows with the largest id all keep the line;
    null ids are below all others. Columns named n_lines or n_dropped are replaced.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    src = docs.select(F.col(id_col).alias("id"), tx.row_key(docs, id_col, text_col).alias("row_key"),
                      F.col(text_col).cast("binary").alias("text"))
    seen = bloom.filters(src.select("text"), _hashes(min_chars), bloom.bits_for(tx.total_bytes(docs, text_col) // 100))
    schema = f"id {src.schema['id'].dataType.simpleString()}, row_key long, key binary"
    suspects = materialise(src.mapInArrow(tx.trimmed(_suspects(seen, min_chars)), schema), "lines")
    # a table of its own, so that a line of very many documents is a skewed join that is split
    shared = materialise(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
                         .where(F.col("n") >= min_docs).select("key", "keeper"), "shared")
    drop = (suspects.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "row_key").agg(F.collect_set("key").alias("drop")))
    d = docs.withColumns({"n_lines": F.lit(None), "n_dropped": F.lit(None)}).drop("n_lines", "n_dropped")
    d = d.select(F.struct("*").alias("doc"), d[id_col].alias("id"), tx.row_key(d, id_col, text_col).alias("row_key"))
    d = d.join(drop.select(F.col("id").alias("_id"), F.col("row_key").alias("_key"), "drop"),
               F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    cleaned = F.arrow_udf(_cleaned, "struct<text binary, n_lines long, n_dropped long>")
    new = cleaned(F.col(f"doc.`{text_col}`").cast("binary"), "drop")
    return (d.select("doc", new.alias("new"))
            .select(F.col("doc").withField(f"`{text_col}`", F.col("new.text").cast("string")).alias("doc"), "new")
            .select("doc.*", "new.n_lines", "new.n_dropped"))
