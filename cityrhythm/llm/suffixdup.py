"""Byte passages that occur twice, found with run-length compressed indexes.

Where a string of ``length`` bytes lies, the smallest hash among its 48-byte
grams picks an anchor, the same one wherever the string occurs. Neighbouring
strings with one anchor form a segment, and equal strings always meet under
one anchor. In a run of a short period (one byte over and over, blank lines)
strings repeat within the run: it is marked at once, and only one period of its
strings goes on, to be met by equal ones elsewhere. Two Bloom filters drop the
anchors that occur once. The segments
that remain, each distinct one once, are indexed by anchor: a Burrows-Wheeler
transform of their suffixes, kept as runs, with the suffixes at the ends of
the runs sampled. Only there is a longest common prefix measured; elsewhere the
matching statistics follow from the position before, one byte shorter, in one
stream over the segment. Positions with at least ``length`` are marked.
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

U64 = np.uint64
GRAM = 48
#: Window starts handled together; a local position fits into the low 20 bits.
CHUNK = 1 << 19
#: Suffixes indexed together, about, and the segments of one anchor that may be.
BLOCK, MAX_GROUP = 60_000, 1_000
#: Windows in a piece of a segment, where an anchor has more segments than that.
PIECE = 16


def runs(buf: np.ndarray, off: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal rows of windows (first, past the last) of one text that a period of at most ``GRAM`` bytes makes equal to others of the row; the period."""
    n = len(buf)
    out: list[tuple[int, int, int]] = []
    if n < length + 1:
        return out
    words = np.ndarray((n - 7,), np.dtype("<u8"), buffer=buf.data, strides=(1,))
    step = length // 4      # the bytes of a row hold three neighbouring probes of eight bytes at least
    probe = words[::step]
    borders = off[1:-1]
    for p in range(1, min(GRAM, n - length) + 1):
        later = words[p::step]
        hit = np.concatenate([[0], probe[:len(later)] == later, [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(hit))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x < 3:
                continue
            lo, hi = max((x - 1) * step, 0), min(y * step + 8, n - p)
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = buf[lo:hi] == buf[lo + p:hi + p]
            for o in borders[np.searchsorted(borders, lo):np.searchsorted(borders, hi + p, "right")].tolist():
                same[max(o - p - lo, 0) + 1:max(o - lo, 0) + 1] = 0
            side = np.flatnonzero(np.diff(same)) + lo
            out += [(u, v - length + 1 + p, p) for u, v in zip(side[::2].tolist(), side[1::2].tolist()) if v - u >= length]
    return out


def _kept(found: list[tuple[int, int, int]], n: int) -> np.ndarray | None:
    """Which windows go on: of each row those of its first period."""
    if not found:
        return None
    keep = np.ones(n, bool)
    for first, stop, p in found:
        keep[first + p:stop] = False
    return keep


def segments(buf: np.ndarray, off: np.ndarray, length: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Neighbouring windows with one anchor: first window, windows, anchor's place, anchor's hash.

    Windows behind the first period of the periodic rows ``found`` are left out.
    """
    keep = _kept(found, len(buf))
    width = length - GRAM + 1
    for lo in range(0, len(buf) - length + 1, CHUNK):
        hi = min(lo + CHUNK, len(buf) - length + 1)
        part = buf[lo:hi + length - 1]
        at = np.arange(len(part) - GRAM + 1)
        g = tx.spans_hash(part, at, at + GRAM, tx.BYTE_EXACT)
        low = (g & ~U64(0xFFFFF)) | at.astype(U64)
        have = 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
        anchor = (low & U64(0xFFFFF)).astype(np.int64)
        start = np.arange(lo, hi)
        text = np.searchsorted(off, start, "right") - 1 if len(off) < 64 else _owner(off, lo, hi)
        whole = start + length <= off[text + 1]
        if keep is not None:
            whole &= keep[lo:hi]
        new = np.empty(hi - lo, bool)
        new[0] = True
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        ends = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole) + 1
        yield first + lo, ends - first, anchor[first] + lo, g[anchor[first]]


def _owner(off: np.ndarray, lo: int, hi: int) -> np.ndarray:
    mark = np.zeros(hi - lo, np.int64)
    a, b = np.searchsorted(off, lo, "right"), np.searchsorted(off, hi, "left")
    np.add.at(mark, off[a:b] - lo, 1)
    return np.cumsum(mark) + a - 1


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, buf, off in tx.texts(batch["text"]):
                for _, _, _, g in segments(buf, off, length, runs(buf, off, length)):
                    yield g
    return run


def _suspects(seen, length: int):
    names = ["id", "row_key", "start", "lead", "gram", "seg_id", "segment", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, buf, off in tx.texts(batch["text"]):
                found = runs(buf, off, length)
                if found:       # repeated within themselves, whatever else there is
                    first = np.array([x[0] for x in found])
                    text = np.searchsorted(off, first, "right") - 1
                    at, k = pa.array(text + row), len(found)
                    yield pa.record_batch([batch["id"].take(at), batch["row_key"].take(at), pa.array(first - off[text]), pa.nulls(k, pa.int32()),
                                           pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
                                           pa.array([x[1] - x[0] for x in found], pa.int64())], names=names)
                for first, n, anchor, g in segments(buf, off, length, found):
                    hit = bloom.has(seen.value, g)
                    if not hit.any():
                        continue
                    first, n, anchor, g = first[hit], n[hit], anchor[hit], g[hit]
                    seg = [buf[a:b].tobytes() for a, b in zip(first.tolist(), (first + n + length - 1).tolist())]
                    text = np.searchsorted(off, first, "right") - 1
                    at = pa.array(text + row)
                    # a segment is told by its bytes and where its anchor lies in them
                    ids = [hashlib.blake2b(s, digest_size=16, salt=x.to_bytes(8, "little")).digest()
                           for s, x in zip(seg, (anchor - first).tolist())]
                    yield pa.record_batch([batch["id"].take(at), batch["row_key"].take(at), pa.array(first - off[text]),
                                           pa.array((anchor - first).astype(np.int32)), pa.array(g.view(np.int64)),
                                           pa.array(ids, pa.binary()), pa.array(seg, pa.binary()), pa.nulls(len(seg), pa.int64())], names=names)
    return run


def repeated(segs: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, whether the string at each of its windows occurs again, there or in another one."""
    size = np.array([len(s) for s in segs])
    windows = size - length + 1
    wide = int(size.max())
    pad = bytes(wide)
    text = np.frombuffer(pad.join(segs) + pad, np.uint8)
    base = np.concatenate([[0], np.cumsum(size + wide)[:-1]])
    owner = np.repeat(np.arange(len(segs)), windows)
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    at = base[owner] + np.arange(windows.sum()) - first[owner]
    rest = base[owner] + size[owner] - at
    suffix = np.lib.stride_tricks.sliding_window_view(text, wide)[at]
    order = np.argsort(suffix.view(f"S{wide}").ravel(), kind="stable")
    # the transform: the byte before each suffix in order, and none before a segment's first one
    before = np.where(at > base[owner], text[at - 1].astype(np.int16), -1)[order]
    ends = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] < 0))
    a, b = order[ends], order[ends + 1]
    sample = np.zeros(len(at), np.int64)
    for i in range(0, len(ends), 8192):
        x, y = a[i:i + 8192], b[i:i + 8192]
        differ = suffix[x] != suffix[y]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        lcp = np.minimum(lcp, np.minimum(rest[x], rest[y]))
        np.maximum.at(sample, x, lcp)
        np.maximum.at(sample, y, lcp)
    many = copies > 1
    sample[first[many]] = size[many]
    match = np.maximum.accumulate(sample + at) - at
    return np.split(match >= length, first[1:])


def _index(length: int):
    names = ["seg_id", "from", "to"]

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield from zip(b["grp"].to_pylist(), b["seg_id"].to_pylist(), b["skip"].to_pylist(), b["n"].to_pylist(), b["segment"].to_pylist())

    def ranges(block: list[tuple]) -> pa.RecordBatch:
        ids, lo, hi = [], [], []
        for r, hit in zip(block, repeated([r[4] for r in block], np.array([r[3] for r in block]), length)):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))) + r[2]
                lo.extend(edge[::2].tolist())
                hi.extend(edge[1::2].tolist())
                ids.extend([r[1]] * (len(edge) // 2))
        return pa.record_batch([pa.array(ids, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, load, group = [], 0, None
        for r in rows(batches):
            if load >= BLOCK and r[0] != group:     # one anchor's segments stay together
                yield ranges(block)
                block, load = [], 0
            group = r[0]
            block.append(r)
            load += len(r[4]) - length + 1
        if block:
            yield ranges(block)
    return run


def _pieces(length: int, step: int):
    """Segments -> pieces of ``step`` window offsets from the anchor, grouped by the bytes that all windows there share."""
    names = ["grp", "seg_id", "skip", "n", "segment", "lead", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for seg_id, skip, n, seg, lead, gram in zip(*(b[c].to_pylist() for c in ("seg_id", "skip", "n", "segment", "lead", "gram"))):
                p, last = 0, len(seg) - length + 1
                while p < last:
                    k = (p - lead) // step
                    lo, hi = k * step + lead, min((k + 1) * step + lead, last)
                    # all windows that start in [lo, lo + step) share these bytes, also where the segment has not all of them
                    core = seg[lo + step - 1:lo + length]
                    grp = hashlib.blake2b(core, digest_size=8, salt=(k & 0xFFFFFFFF).to_bytes(8, "little"), key=gram.to_bytes(8, "little", signed=True)).digest()
                    for o, v in zip(out, (int.from_bytes(grp, "little", signed=True), seg_id, skip + p, n, seg[p:hi + length - 1], lead - p, gram)):
                        o.append(v)
                    p = hi
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))], names=names)
    return run


_ROWS = "grp long, seg_id binary, skip int, n long, segment binary, lead int, gram long"


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    return (rows.select("grp", "seg_id", "skip", "n", "segment").repartition("grp").sortWithinPartitions("grp", "seg_id")
            .mapInArrow(tx.trimmed(_index(length)), "seg_id binary, `from` int, `to` int"))


def _marked(distinct: DataFrame, length: int) -> DataFrame:
    """Repeated window ranges of all distinct segments. An anchor with more than
    MAX_GROUP segments is split by what the windows hold, so that no task gets
    a hot passage whole and equal windows still meet."""
    out, steps = None, [PIECE, 1]
    rows = distinct.withColumn("grp", F.col("gram")).withColumn("skip", F.lit(0))
    while True:
        sizes = rows.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > MAX_GROUP).select("grp")
        sizes = materialise(sizes, "hot")
        if not sizes.limit(1).count():
            found = _indexed(rows, length)
            return found if out is None else out.unionAll(found)
        found = _indexed(rows.join(sizes, "grp", "left_anti"), length)
        out = found if out is None else out.unionAll(found)
        rows = rows.join(sizes, "grp", "left_semi").select("seg_id", "skip", "n", "segment", "lead", "gram")
        rows = materialise(rows.mapInArrow(tx.trimmed(_pieces(length, steps.pop(0))), _ROWS), "pieces")
        if not steps:       # single windows: a group is one string and needs no index
            total = rows.groupBy("grp").agg(F.sum("n").alias("total")).where("total > 1").select("grp")
            one = rows.join(total, "grp").select("seg_id", F.col("skip").alias("from"), (F.col("skip") + 1).alias("to"))
            return out.unionAll(one)


def without(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, int, bytes | None]:
    """Bytes before, bytes removed, maximal removed runs, what is left."""
    if not text:
        return 0, 0, 0, text
    kept, upto, removed, runs, end = [], 0, 0, 0, -1
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if a > end:
            runs += 1
            kept.append(text[upto:a])
            upto = a
        if b > end:
            removed += b - max(a, upto)
            upto = end = b
    kept.append(text[upto:])
    return len(text), removed, runs, b"".join(kept)


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = [without(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in
                                       enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      names=["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept (binary).

    Each byte covered by a string of ``length`` bytes (UTF-8) that also starts
    anywhere else, in the same text or another, is removed; matches don't cross
    texts, overlaps count, and all is judged on the input. ``n_spans`` counts
    maximal removed runs; ``kept`` is what remains, concatenated. Null texts have
    no bytes and stay null. A repeated row is another text, so both lose all
    that is long enough. Ids may be null or repeated.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    src = docs.select(F.col(id_col).alias("id"), tx.row_key(docs, id_col, text_col).alias("row_key"),
                      F.col(text_col).cast("binary").alias("text"))
    bits = bloom.bits_for(2 * tx.total_bytes(docs, text_col) // (length - GRAM))
    seen = bloom.filters(src.select("text"), _anchors(length), bits)
    kind = src.schema["id"].dataType.simpleString()
    found = materialise(src.mapInArrow(tx.trimmed(_suspects(seen, length)),
                                       f"id {kind}, row_key long, start long, lead int, gram long, seg_id binary, segment binary, run long"), "segments")
    distinct = materialise(found.where("seg_id is not null").groupBy("gram", "seg_id").agg(F.first("segment").alias("segment"), F.first("lead").alias("lead"),
                                                               F.count("*").alias("n")), "distinct")
    marked = materialise(_marked(distinct, length), "marked")
    spans = (found.select("id", "row_key", "start", "seg_id").join(marked, "seg_id")
             .select("id", "row_key", F.struct((F.col("start") + F.col("from")).alias("a"),
                                               (F.col("start") + F.col("to") - 1 + length).alias("b")).alias("s"))
             .unionByName(found.where("run is not null")
                          .select("id", "row_key", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("run") - 1 + length).alias("b")).alias("s")))
             .groupBy(F.col("id").alias("i"), F.col("row_key").alias("k")).agg(F.collect_set("s").alias("spans")))
    cut = F.arrow_udf(_cut, "struct<n_bytes long, n_removed long, n_spans long, kept binary>")
    return (src.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("row_key") == F.col("k")), "left")
            .select(F.col("id").alias(id_col), cut("text", "spans").alias("c")).select(id_col, "c.*"))
