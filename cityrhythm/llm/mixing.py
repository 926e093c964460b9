"""Sources interleaved to target weights by Pfair scheduling.

Time is a row of slots, each holding one block of one source. With target
weight w, a source's k-th block is released at floor(k / w) and due by
ceil((k + 1) / w); serving the released block that is due first keeps every
deadline, so after any number t of slots a source that has blocks left has had
its w * t blocks to less than one. Weights are whole numbers over their sum, so
the schedule repeats after that many slots. One task makes it, slot by slot,
for one period or until the blocks end, whichever comes first, and writes it
as a table; documents find their slots by joining that table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import materialise

BLOCK_BYTES = 16_384
#: Weights that have no smaller common denominator are multiples of one in so many (2^52).
FINEST = 1 << 52
#: Documents that one window task puts in order, about, and sums of such that another adds up.
BUCKET_DOCS, BUCKETS_A_GROUP = 1_000, 1_000
#: Slots handed on together.
BATCH = 1 << 16
COLUMNS = ["mix_weight", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mixed"]


def shares(weights: list[Fraction]) -> list[int]:
    """Slots a period for each weight: the exact ratios in lowest terms, unless their sum passes ``FINEST``."""
    if not weights:
        return []
    unit = math.lcm(*(w.denominator for w in weights))
    out = [int(w * unit) for w in weights]
    common = math.gcd(*out)
    out = [x // common for x in out]
    total = sum(out)
    return out if total <= FINEST else [max(1, x * FINEST // total) for x in out]


def schedule(share: list[int], blocks: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Slot, source, block, release and deadline for one period: earliest deadline first among released blocks.

    A source of fewer ``blocks`` than its share leaves the rest of its slots to the others' released blocks, or empty.
    """
    period = sum(share)
    upto = share if blocks is None else [min(s, b) for s, b in zip(share, blocks)]
    waiting = [(0, i, 0) for i in range(len(share)) if upto[i] > 0]      # release, source, block
    ready: list[tuple[int, int, int, int]] = []                          # deadline, source, block, release
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[i]), i, k, release))
        due, i, k, release = heapq.heappop(ready)
        yield t, i, k, release, due
        if k + 1 < upto[i]:
            heapq.heappush(waiting, ((k + 1) * period // share[i], i, k + 1))
        t += 1


def _sources(given: dict, block_bytes: int):
    """Sources with bytes and rows -> also their number, share, period, blocks and buckets."""
    names = ["s", "i", "share", "period", "blocks", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind = [], None
        for b in batches:
            kind = b["s"].type
            rows.extend(zip(b["s"].to_pylist(), b["bytes"].to_pylist(), b["n"].to_pylist()))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
        share = shares([given[s] if s in given else Fraction(max(1, math.isqrt(size))) for s, size, _ in rows])
        yield pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array(range(len(rows)), pa.int64()), pa.array(share, pa.int64()),
                               pa.array([sum(share)] * len(rows), pa.int64()),
                               pa.array([max(0, size - 1) // block_bytes + 1 for _, size, _ in rows], pa.int64()),
                               pa.array([-(-n // BUCKET_DOCS) for _, _, n in rows], pa.int64())], names=names)
    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources -> the slots of one period."""
    names = ["slot", "i", "j", "release", "due"]
    rows = [r for b in batches for r in zip(*(b[c].to_pylist() for c in ("i", "share", "blocks")))]
    rows.sort()
    out: list[tuple[int, int, int, int, int]] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    for place in schedule([r[1] for r in rows], [r[2] for r in rows]):
        out.append(place)
        if len(out) == BATCH:
            yield batch()
            out.clear()
    if out:
        yield batch()


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block_bytes: int = BLOCK_BYTES, seed: int = 17) -> DataFrame:
    """``docs`` with its place in the mixture: mix_weight, mix_block, mix_release, mix_deadline, mix_slot, mixed.

    Reading the rows by mix_slot gives the mixture. A source's documents follow
    one another in a pseudo-random order fixed by ``seed``; a block is
    ``block_bytes`` bytes (UTF-8) of that sequence and a document belongs to the
    block where it begins. ``weights`` gives the target of each source, taken as
    the decimal number that it is written as; sources that it lacks, and all
    without it, weigh as the square root of their bytes (its whole part, 1 at
    least). Every document is placed: ``mixed`` is true for slots before the one
    where some source has its last block; behind it the other sources go on in
    their own slots. Any number of sources is taken: the task that makes the
    schedule holds a few hundred bytes a source, and its time follows the
    blocks or the period, the lesser, so larger corpora want larger blocks.

    Null is a source like any other; null and empty texts have no bytes; very
    long texts are one document of their first block; an empty table gives no
    rows; repeated rows are placed one by one. Columns of the new names are
    replaced, all others stay as they are, whatever their names.
    """
    given = {s: Fraction(repr(float(w))) if math.isfinite(w) else Fraction(0) for s, w in (weights or {}).items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS])
    own, mark = d.columns, "__"
    while any(c.lower().startswith(mark) for c in own):
        mark += "_"
    c = {n: mark + n for n in ("id", "h", "size", "s", "i", "share", "period", "buckets", "bucket", "group", "sum", "before", "start",
                               "base", "k", "j", "pi", "pj", "slot", "release", "due", "at")}
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    stats = d.groupBy(F.col(f"`{source_col}`").alias("s")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    kind = d.select(F.col(f"`{source_col}`")).schema[0].dataType.simpleString()
    sources = materialise(stats.repartition(1).mapInArrow(
        tx.trimmed(_sources(given, block_bytes)), f"s {kind}, i long, share long, period long, blocks long, buckets long"), "mix-sources")
    places = materialise(sources.repartition(1).mapInArrow(
        tx.trimmed(_slots), "slot long, i long, j long, release long, due long"), "mix-slots")
    last = sources.select("i", "period", F.expr("(blocks - 1) div share").alias("round"), F.expr("(blocks - 1) % share").alias("j"))
    full = last.join(places, ["i", "j"]).agg(F.min(F.col("round") * F.col("period") + F.col("slot"))).first()[0] or 0

    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    src = sources.select(*[F.col(n).alias(c[n]) for n in ("s", "i", "share", "period", "buckets")])
    # the text itself takes part in no shuffle unless the caller reads it
    d = (d.withColumns({c["id"]: F.col(f"`{id_col}`"), c["h"]: h, c["size"]: size})
         .join(src, F.col(f"`{source_col}`").eqNullSafe(F.col(c["s"])))
         .withColumn(c["bucket"], F.pmod(F.xxhash64(c["h"]), F.col(c["buckets"]))))
    # what lies before a bucket: sums of groups of buckets, then of buckets within their group
    group = F.floor(F.col(c["bucket"]) / F.lit(BUCKETS_A_GROUP))
    sums = materialise(d.groupBy(c["i"], c["bucket"]).agg(F.sum(c["size"]).alias(c["sum"])).withColumn(c["group"], group), "mix-sums")

    def before(*by: str, order: list[str]) -> Window:
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    bases = (sums.groupBy(c["i"], c["group"]).agg(F.sum(c["sum"]).alias(c["sum"]))
             .select(c["i"], c["group"], F.coalesce(F.sum(c["sum"]).over(before(c["i"], order=[c["group"]])), F.lit(0)).alias(c["base"])))
    starts = (sums.withColumn(c["start"], F.coalesce(F.sum(c["sum"]).over(before(c["i"], c["group"], order=[c["bucket"]])), F.lit(0)))
              .join(bases, [c["i"], c["group"]])
              .select(c["i"], c["bucket"], (F.col(c["start"]) + F.col(c["base"])).alias(c["start"])))
    inner = before(c["i"], c["bucket"], order=[c["h"], c["id"]])
    slots = places.select(F.col("i").alias(c["pi"]), F.col("j").alias(c["pj"]), *[F.col(n).alias(c[n]) for n in ("slot", "release", "due")])
    d = (d.withColumn(c["before"], F.coalesce(F.sum(c["size"]).over(inner), F.lit(0))).join(starts, [c["i"], c["bucket"]])
         .withColumn(c["k"], F.expr(f"({c['start']} + {c['before']}) div {int(block_bytes)}"))
         .withColumn(c["j"], F.col(c["k"]) % F.col(c["share"]))
         .join(slots, (F.col(c["i"]) == F.col(c["pi"])) & (F.col(c["j"]) == F.col(c["pj"]))))
    # whole periods are added to the places of the first one
    rounds = F.expr(f"{c['k']} div {c['share']}") * F.col(c["period"])
    at = rounds + F.col(c["slot"])
    return d.select(*[F.col(f"`{n}`") for n in own], (F.col(c["share"]) / F.col(c["period"])).alias("mix_weight"),
                    F.col(c["k"]).alias("mix_block"), (rounds + F.col(c["release"])).alias("mix_release"),
                    (rounds + F.col(c["due"])).alias("mix_deadline"), at.alias("mix_slot"), (at < full).alias("mixed"))
