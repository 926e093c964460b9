"""Nearest neighbours by cross-polytope hashing with multiprobe tables.

A vector is turned by pseudo-rotations (three rounds of random signs and a
fast Hadamard transform) and assigned to the nearest signed axis; two or more
such hashes make its bucket in a table. A query looks into the buckets of
least distance in every table, and the vectors found are ranked exactly by
their cosine in double precision.

Equal vectors are one class with its few smallest ids, so a vector held by a
third of the rows costs as much as any other. Buckets are dealt to shards of
bounded size; a query goes to the shards of its buckets and comes back with
its best few of each, so pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

TABLES = 10
#: Classes in a shard, about, and classes a bucket should have.
SHARD, PER_BUCKET = 20_000, 64
_signs: dict[tuple[int, int, int], np.ndarray] = {}


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = y.shape
    h = 1
    while h < d:
        z = y.reshape(n, -1, 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


def rotated(x: np.ndarray, table: int, k: int) -> np.ndarray:
    """Rows of ``x``, padded to a power of two, under the pseudo-rotation of a table's k-th hash."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    if (table, k, d) not in _signs:
        _signs[table, k, d] = np.random.Generator(np.random.PCG64([11, table, k, d])).choice([-1.0, 1.0], (3, d))
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for s in _signs[table, k, d]:
        y = hadamard(y * s)
    return y


class Layout:
    """Hashes in a bucket and axes of the last one, for so many vectors."""

    def __init__(self, count: int):
        self.hashes, self.last = 2, 16
        while self.buckets(64) * PER_BUCKET < count:
            if self.last < 64:
                self.last *= 2
            else:
                self.hashes, self.last = self.hashes + 1, 2
        self.shards = -(-count // SHARD) or 1

    def looked(self, dims: int) -> int:
        """Buckets that a query looks into in each table: twice the root of their number.

        A query's share of the table falls with its size, but slowly enough for the recall to hold.
        """
        return 2 * math.isqrt(self.buckets(dims))

    def buckets(self, dims: int) -> int:
        return (2 * dims) ** (self.hashes - 1) * 2 * min(self.last, dims)

    def axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash, every signed axis's distance behind the nearest one."""
        out = []
        for k in range(self.hashes):
            y = rotated(x, table, k)
            if k == self.hashes - 1:
                y = y[:, :self.last]
            out.append(np.abs(y).max(axis=1)[:, None] - np.concatenate([y, -y], axis=1))
        return out

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for behind in self.axes(x, table):
            code = code * behind.shape[1] + behind.argmin(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Bucket numbers by growing squared distance, ``looked`` at most."""
        axes = self.axes(x, table)
        most = self.looked(1 << max(1, (x.shape[1] - 1).bit_length()))
        out = []
        for i in range(len(x)):
            cost, code = np.zeros(1), np.zeros(1, np.int64)
            for behind in axes:
                c = behind[i] ** 2
                cost = (cost[:, None] + c[None, :]).ravel()
                code = (code[:, None] * len(c) + np.arange(len(c))[None, :]).ravel()
                if len(cost) > 4 * most:
                    keep = np.argpartition(cost, 4 * most - 1)[:4 * most]
                    cost, code = cost[keep], code[keep]
            out.append(code[np.argsort(cost, kind="stable")[:most]])
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which is exact: the largest component is below 1, and no square leaves the range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with vectors of one length, and the vectors made unit length."""
    vec = batch["vec"].to_pylist()
    size = np.array([len(v) for v in vec])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.array([vec[i] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _filed(layout: Layout):
    """Classes -> a row for each table: shard and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_size(batch):
                part = batch.take(pa.array(at))
                for t in range(TABLES):
                    code = layout.codes(x, t)
                    yield pa.record_batch([pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(np.full(len(at), t, np.int32)),
                                           pa.array((code % layout.shards).astype(np.int32)), pa.array(code), part["cls"], part["vec"]],
                                          names=["dims", "tab", "shard", "code", "cls", "vec"])
    return run


def _asked(layout: Layout):
    """Query classes -> a row for each table and shard, with the buckets to look into there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dims", "tab", "shard", "codes", "cls", "vec"]
        for batch in batches:
            for at, x in _by_size(batch):
                part = batch.take(pa.array(at))
                for t in range(TABLES):
                    pick, shard, codes = [], [], []
                    for i, c in enumerate(layout.probes(x, t)):
                        own = c % layout.shards
                        for s in np.unique(own):
                            pick.append(i)
                            shard.append(int(s))
                            codes.append(np.sort(c[own == s]))
                    rows = part.take(pa.array(pick, pa.int64()))
                    yield pa.record_batch([pa.array(np.full(len(pick), x.shape[1], np.int32)), pa.array(np.full(len(pick), t, np.int32)),
                                           pa.array(shard, pa.int32()), pa.array(codes, pa.list_(pa.int64())), rows["cls"], rows["vec"]], names=names)
    return run


def _ranked(top: int):
    """Sorted rows of blocks, classes before queries -> each query's best ``top`` in the block."""
    key, names = ("dims", "tab", "shard", "part"), ["q", "cls", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, block = None, [], None
        for batch in batches:
            out: list[list] = [[], [], []]
            for k, is_query, code, codes, cls, vec in zip(zip(*(batch[c].to_pylist() for c in key)), *(batch[c].to_pylist() for c in ("query", "code", "codes", "cls", "vec"))):
                if k != now:
                    now, rows, block = k, [], None
                if not is_query:
                    rows.append((code, cls, vec))
                    continue
                if not rows:
                    continue
                if block is None:
                    rows.sort(key=lambda r: r[0])
                    x = scaled(np.array([r[2] for r in rows], np.float64))
                    block = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), x, np.sqrt((x * x).sum(axis=1)))
                code_of, cls_of, x, norm = block
                if codes is None:
                    at = np.arange(len(x))
                else:
                    lo, hi = np.searchsorted(code_of, codes, "left"), np.searchsorted(code_of, codes, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                if not len(at):
                    continue
                v = scaled(np.array(vec, np.float64))
                score = (x[at] * v).sum(axis=1) / (norm[at] * np.sqrt((v * v).sum()))
                best = np.lexsort((cls_of[at], -score))[:top]
                out[0].extend([cls] * len(best))
                out[1].extend(cls_of[at[best]].tolist())
                out[2].extend(score[best].tolist())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=names)
    return run


def _searched(filed: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """Each query class's best classes: q, cls, score."""
    shard = ["dims", "tab", "shard"]
    sizes = materialise(filed.groupBy(*shard).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")), "shards")
    rows = (filed.join(sizes, shard).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
            .select(*shard, "part", F.lit(False).alias("query"), "code", F.lit(None).cast("array<long>").alias("codes"), "cls", "vec"))
    queries = (asked.join(sizes, shard).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .select(*shard, "part", F.lit(True).alias("query"), F.lit(None).cast("long").alias("code"), "codes", "cls", "vec"))
    return (rows.unionAll(queries).repartition(*shard, "part").sortWithinPartitions(*shard, "part", "query")
            .mapInArrow(_ranked(top), "q long, cls long, score double").groupBy("q", "cls").agg(F.max("score").alias("score")))


def neighbours(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest others of each query: query_id, rank, id_col, score.

    ``queries`` is a condition on ``vectors`` (a column). Nearness is the cosine in
    double precision, ties go to the smaller id; a query gets all others if
    they are fewer than ``k``. Rows whose id is null, or whose vector is null,
    zero or holds null or non-finite components, take no part; vectors of
    different lengths are no candidates for each other. Of several rows with
    one id the one with the smallest vector counts.

    Every vector is indexed. A query that finds too few in its buckets is
    searched again, exactly, against all vectors of its length.
    """
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    ok = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    ok = materialise(ok.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
                     .groupBy("id").agg(F.min(F.struct("vec", "asks")).alias("v")).select("id", "v.vec", "v.asks"), "vectors")
    # one class for equal vectors, with as many of its smallest ids as any answer can need
    low = ok.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = materialise(low.groupBy("vec").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asking = materialise(ok.where("asks").select("id", "vec").join(classes.select("vec", "cls"), "vec").select("id", "cls"), "asking")
    q_classes = materialise(asking.select("cls").distinct().join(classes.select("cls", "vec"), "cls").select("cls", "vec"), "queries")
    layout = Layout(classes.count())
    kind = "dims int, tab int, shard int, {}, cls long, vec array<double>"
    filed = materialise(classes.select("cls", "vec").mapInArrow(_filed(layout), kind.format("code long")), "filed")
    asked = q_classes.mapInArrow(_asked(layout), kind.format("codes array<long>"))
    found = materialise(_searched(filed, asked, k + 1), "found")
    # ids found, the query's own included; short ones are searched in all of one table
    held = classes.select("cls", F.size("ids").alias("n"))
    have = found.join(held, "cls").groupBy("q").agg(F.sum("n").alias("n"))
    short = (q_classes.join(have, q_classes["cls"] == have["q"], "left").where(F.coalesce("n", F.lit(0)) <= k)
             .select("cls", "vec", F.size("vec").alias("dims")))
    short = materialise(short, "short")
    if short.limit(1).count():
        once = filed.where("tab = 0")
        everywhere = (short.join(once.select("dims", "tab", "shard").distinct(), "dims")
                      .select("dims", "tab", "shard", F.lit(None).cast("array<long>").alias("codes"), "cls", "vec"))
        again = _searched(once, everywhere, k + 1)
        found = found.join(short.select(F.col("cls").alias("q")), "q", "left_anti").unionAll(again.select("q", "cls", "score"))
    best = (found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).where(F.col("n") <= k + 1)
            .join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("other"))
            .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "other"))).where(F.col("n") <= k + 1)
            .select(F.col("q").alias("cls"), "score", "other"))
    return (asking.join(best, "cls").where("other <> id")
            .withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score"))
