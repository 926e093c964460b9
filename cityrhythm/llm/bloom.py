"""Two Bloom filters over a whole table: hashes seen once, hashes seen twice.

Each task fills its own pair of bitmaps; the pairs are united in slices, a
slice being repeated where either task saw it twice or both saw it. The
filters have no false negatives: a hash seen at least twice anywhere always
tests positive in the second one. Their size is a power of two that follows
the input and is bounded by ``MAX_BITS`` (32 MiB a bitmap), so the result may
be broadcast at any scale; a fuller filter only lets more suspects through,
which the callers confirm exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import text as tx

U64 = np.uint64
MIN_BITS, MAX_BITS = 1 << 18, 1 << 28
SLICE = 1 << 15     # bytes
SCHEMA = "slice int, once binary, twice binary"

Hashes = Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]


def bits_for(items: int) -> int:
    """Power of two, at least 16 bits an item within the bounds."""
    bits = MIN_BITS
    while bits < min(16 * items, MAX_BITS):
        bits *= 2
    return bits


def _at(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(bits - 1)
    return h & mask, (h >> U64(32)) & mask


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash, whether the bitmap has both its bits."""
    a, b = _at(h, len(bitmap) * 8)
    got = (bitmap[a >> U64(3)] >> (a & U64(7)).astype(np.uint8)) & 1
    got &= (bitmap[b >> U64(3)] >> (b & U64(7)).astype(np.uint8)) & 1
    return got.astype(bool)


def put(bitmap: np.ndarray, h: np.ndarray) -> None:
    for p in _at(h, len(bitmap) * 8):
        np.bitwise_or.at(bitmap, (p >> U64(3)).astype(np.int64), np.uint8(1) << (p & U64(7)).astype(np.uint8))


def filters(df: DataFrame, hashes: Hashes, bits: int, seen: int = 2) -> Broadcast:
    """Broadcast bitmap (numpy bytes) of the hashes that the table has ``seen`` (1 or 2) times.

    ``hashes`` turns a task's batches into arrays; a hash counts as often as it
    comes.
    """
    size = bits // 8
    part = min(SLICE, size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for h in hashes(batches):
            if len(h) == 0:
                continue
            u, n = np.unique(h, return_counts=True)
            if seen == 2:
                again = u[(n > 1) | has(once, u)]
                put(twice, again)
            put(once, u)
        for k in range(0, size, part):
            o, t = once[k:k + part], twice[k:k + part]
            if o.any():
                yield pa.record_batch([pa.array([k // part], pa.int32()), pa.array([o.tobytes()], pa.binary()),
                                       pa.array([t.tobytes() if seen == 2 else b""], pa.binary())],
                                      names=["slice", "once", "twice"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done():
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([once.tobytes()], pa.binary()),
                                    pa.array([twice.tobytes()], pa.binary())], names=["slice", "once", "twice"])

        for b in batches:
            for k, o, t in zip(b["slice"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist()):
                if k != now:
                    if now is not None:
                        yield done()
                    now, once, twice = k, np.zeros(part, np.uint8), np.zeros(part, np.uint8)
                o = np.frombuffer(o, np.uint8)
                if seen == 2:
                    twice |= np.frombuffer(t, np.uint8) | (once & o)
                once |= o
        if now is not None:
            yield done()

    sc = df.sparkSession.sparkContext
    parts = df.mapInArrow(tx.trimmed(fill), SCHEMA)
    rows = (parts.repartition(max(1, min(size // part, 64)), "slice").sortWithinPartitions("slice")
            .mapInArrow(tx.trimmed(unite), SCHEMA).select("slice", "once" if seen == 1 else "twice").collect())
    bitmap = np.zeros(size, np.uint8)
    for r in rows:
        bitmap[r[0] * part:r[0] * part + part] = np.frombuffer(r[1], np.uint8)
    return sc.broadcast(bitmap)
