"""Whole texts as bytes: words, lines and their hashes, a batch at a time.

The texts of a batch lie one behind another in one Arrow buffer. Everything
here works on that buffer with numpy, so the cost is a few nanoseconds a byte
and no Python object is made for a word or a line. Hashes are 64 bits wide:
a polynomial over per-byte random numbers, finished by an avalanche step.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are taken together up to so many bytes; a longer one comes alone.
BATCH_BYTES = 1 << 20
#: Within a long text, words are hashed in stretches of about so many bytes.
STRETCH = 1 << 19
_P = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Per byte, with A-Z as a-z.
BYTE_LOWER = _BYTE[_LOWER]
BYTE_EXACT = _BYTE
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~SPACES
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit numbers (new array)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The polynomial's base to 0..n, and its inverse to 0..n, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, STRETCH + 1)
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a binary column: first row, past the last, bytes, offsets.

    Nulls are empty. Offsets count from the stretch's first byte.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    wide = pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + BATCH_BYTES, "right")) - 1)
        yield a, b, buf[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray,
          table: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words: starts, ends, hashes, and for each text the index of its first word (one more at the end)."""
    starts, ends, hashes = [], [], []
    pos, n = 0, len(buf)
    while pos < n:
        end, step = min(pos + STRETCH, n), STRETCH
        mask = is_word[buf[pos:end]]
        while end < n:      # end behind a byte that is of no word, or at a text's end
            gap = len(mask) - 1 - int(np.argmin(mask[::-1])) if not mask.all() else -1
            cut = int(off[np.searchsorted(off, end, "right") - 1])
            stop = max(pos + gap + 1, cut)
            if stop > pos:
                end = stop
                mask = mask[:end - pos]
                break
            step *= 2
            end = min(pos + step, n)
            mask = is_word[buf[pos:end]]
        m = end - pos
        prev = np.empty(m, bool)
        prev[0] = False
        prev[1:] = mask[:-1]
        inner = off[np.searchsorted(off, pos, "left"):np.searchsorted(off, end, "left")] - pos
        prev[inner] = False
        s = np.flatnonzero(mask & ~prev)
        nxt = np.empty(m, bool)
        nxt[-1] = False
        nxt[:-1] = mask[1:]
        nxt[inner[inner > 0] - 1] = False
        e = np.flatnonzero(mask & ~nxt) + 1
        hashes.append(spans_hash(buf[pos:end], s, e, table))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = end
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(off), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, off, "left")


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    p, inv = powers(len(buf))
    h = np.empty(len(buf) + 1, U64)
    h[0] = 0
    np.cumsum(table[buf] * p[:len(buf)], dtype=U64, out=h[1:])
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_C = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbours in a sequence of hashes, text borders not regarded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _C[0]
    for i in range(1, k):
        out += h[i:i + n] * _C[i]
    return mix(out + U64(k))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and each one's word index.

    ``short``: a text of fewer words, but not none, has its whole sequence.
    """
    all_k = joined(h, k)
    last = np.repeat(first[1:], np.diff(first))[:len(all_k)]
    at = np.flatnonzero(np.arange(len(all_k)) + k <= last)
    out = all_k[at]
    if short:
        counts = np.diff(first)
        for n in range(1, k):
            w = first[:-1][counts == n]
            if len(w):
                at = np.concatenate([at, w])
                out = np.concatenate([out, joined(h, n)[w]])
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
    return out, at


def trimmed(run: Callable) -> Callable:
    """A task's function that gives its freed memory back to the system when the task ends; Python workers are kept."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    return task


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows of one id and different texts apart; equal for repeated rows."""
    return F.xxhash64(docs[id_col], docs[text_col])


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
