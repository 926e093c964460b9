"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard confirmation.

Signatures need two permutations only (Li & Li, C-MinHash, 2022). The first
one scatters a shingle over 2^20 places; the second, shifted circularly by
0, 1, 2, ..., gives one coordinate a shift. What an element contributes to all
coordinates lies side by side in the second permutation, so a signature is a
minimum over short contiguous rows.

Texts with equal shingle sets form one class from the start. Classes that
share a band with another class are gathered under that bucket's smallest
class; within such a gathering, in blocks of bounded size, full shingle sets
are compared, and a spanning forest of the true links is given out rather
than every pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import materialise

U64 = np.uint64
PLACES = 1 << 20
#: What a link at the threshold is missed by the bands with, at most; coordinates of a signature, if more than one row a band.
MISSED, MOST_COORDINATES = 4e-6, 384
#: Shingles in a block of a gathering (8 bytes each), about.
BLOCK_SHINGLES = 200_000
_perms: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def banding(percent: int) -> tuple[int, int]:
    """Bands, and rows a band, for links of ``percent`` %: the most rows with which ``MISSED`` holds.

    More rows a band mean fewer unlike pairs to compare, and more bands.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    out = None
    for rows in range(1, 9):
        miss = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log(miss)) if miss > 0 else 1
        if out is None or bands * rows <= MOST_COORDINATES:
            out = bands, rows
    return out


BANDS, BAND_ROWS = banding(85)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one with its rows of ``k`` shifts."""
    if k not in _perms:
        rng = np.random.Generator(np.random.PCG64(7))
        first = rng.permutation(PLACES).astype(np.uint32)
        second = rng.permutation(PLACES).astype(np.uint32)
        _perms[k] = first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k - 1]]), k)
    return _perms[k]


def signature(shingles: np.ndarray, k: int = BANDS * BAND_ROWS) -> np.ndarray:
    """All ``k`` coordinates of a non-empty set of 64-bit shingle hashes."""
    first, shifts = permutations(k)
    at = first[(shingles & U64(PLACES - 1)).astype(np.int64)]
    out = shifts[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, shifts[at[i:i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key a band."""
    rows = sig.reshape(-1, band_rows).astype(U64)
    h = np.arange(1, len(rows) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for i in range(band_rows):
        h = tx.mix(h ^ (rows[:, i] * U64(0xC2B2AE3D27D4EB4F) + U64(i)))
    return h


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    for a, b, buf, off in tx.texts(column):
        _, _, h, first = tx.words(buf, off, tx.NOT_SPACE)
        sh, at = tx.shingles(h, first, k, short=True)
        cut = np.searchsorted(at, first)
        for i in range(b - a):
            yield np.unique(sh[cut[i]:cut[i + 1]])


def _profiles(k: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, keys = [], [], []
            for s in shingle_sets(batch["text"], k):
                n.append(len(s))
                if len(s):
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(signature(s, bands * band_rows), band_rows).view(np.int64))
                else:
                    ids.append(None)
                    keys.append(None)
            yield pa.record_batch([batch["id"], batch["row_key"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                                   pa.array(keys, pa.list_(pa.int64()))],
                                  names=["id", "row_key", "n_shingles", "set_id", "bands"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch["text"], k)]
            yield pa.record_batch([batch["cls"], pa.array(sets, pa.binary())], names=["cls", "shingles"])
    return run


def forest(sets: list[np.ndarray], percent: int, done: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs with a Jaccard index of ``percent`` % or more.

    Places where ``done`` are known to be connected with one another.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    stop = np.r_[start[1:], len(flat)]
    values = flat[start]
    seen, links = done.copy(), []
    for seed in range(len(sets)):
        if seen[seed]:
            continue
        seen[seed] = True
        todo = [seed]
        joined_main = False
        while todo:
            i = todo.pop()
            if seen.all() and (joined_main or not done.any()):
                break
            at = np.searchsorted(values, sets[i])
            n = stop[at] - start[at]
            many = n > 1
            at, n = at[many], n[many]
            post = owner[np.repeat(start[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            both = np.bincount(post, minlength=len(sets))
            linked = 100 * both >= percent * (size[i] + size - both)
            new = np.flatnonzero(linked & ~seen)
            if not joined_main:
                main = np.flatnonzero(linked & done)
                if len(main):
                    joined_main = True
                    links.append((i, int(main[0])))
            seen[new] = True
            links.extend((i, int(j)) for j in new)
            todo.extend(new.tolist())
    return links


def _compare(percent: int):
    """Batches sorted by (hub, i, j) -> spanning links of each block pair."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("hub", "i", "j", "cls", "main", "shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            group = list(group)
            if len(group) < 2:
                continue
            cls = [r[3] for r in group]
            for x, y in forest([np.frombuffer(r[5], U64) for r in group], percent, np.array([r[4] for r in group])):
                a.append(cls[x])
                b.append(cls[y])
            if len(a) >= 10_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs``: hub, i, j, cls, main -> links a, b."""
    rows = pairs.join(sets, "cls").select("hub", "i", "j", "cls", "main", "shingles")
    return (rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "cls")
            .mapInArrow(tx.trimmed(_compare(percent)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id_col, row_key, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a text of fewer
    words than ``shingle`` has its whole sequence as its one shingle; null,
    empty and blank texts have none and are linked with nothing. Rows are
    linked if 100 * intersection >= ``percent`` * union of their sets, confirmed
    on the full sets (of 64-bit hashes). ``component_id`` is the smallest id
    reachable (null ids are never smallest; null if there is no other), ``kept``
    tells the row that has it. Repeated rows come as often as they are there;
    ``row_key`` (``text.row_key``) tells rows of one id and different texts apart.

    Bands and rows follow ``percent`` (``banding``): a link at the threshold is
    missed with a probability of ``MISSED`` at most, by (1 - 0.85^8)^40 = 3e-6 at
    85 % and (1 - 0.8^7)^53 = 4e-6 at 80 %, where it matters only if no other
    path joins the two. Lower thresholds cost more comparisons, not links.
    """
    return (groups(docs, id_col, text_col, shingle, percent).drop("group")
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` with, for kept, the number of the row's group: null if it has no shingles.

    Groups are told apart where component_id doesn't: with null ids only, or one smallest id for two texts.
    """
    src = docs.select(F.col(id_col).alias("id"), tx.row_key(docs, id_col, text_col).alias("row_key"),
                      F.col(text_col).cast("binary").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, row_key long, n_shingles long, set_id binary, bands array<long>"
    rows = materialise(src.mapInArrow(tx.trimmed(_profiles(shingle, *banding(percent))), schema), "profiles")
    # one class for each set; its exemplar is any row that has it
    classes = materialise(
        rows.where("set_id is not null").groupBy("set_id")
        .agg(F.min("id").alias("low_id"), F.min(F.struct("id", "row_key")).alias("at"), F.first("bands").alias("bands"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    bands = classes.select("cls", F.explode("bands").alias("band"))
    # tables of their own, so that a bucket or gathering of very many classes is a skewed join that is split
    hubs = materialise(bands.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub <> top")
                       .select("band", "hub"), "hubs")
    members = materialise(bands.join(hubs, "band").select("hub", "cls").distinct(), "members")
    wanted = members.select("cls").distinct().join(classes.select("cls", "at"), "cls").select("cls", "at.id", "at.row_key")
    wanted = src.join(wanted, src["id"].eqNullSafe(wanted["id"]) & (src["row_key"] == wanted["row_key"]))
    sets = materialise(wanted.select("cls", "text").mapInArrow(tx.trimmed(_sets(shingle)), "cls long, shingles binary")
                       .dropDuplicates(["cls"]), "sets")
    # blocks of bounded size: each with itself and the first one
    sizes = members.join(sets.select("cls", (F.octet_length("shingles") / 8).alias("n")), "cls")
    blocks = materialise(sizes.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "blocks")
    placed = (members.join(blocks, "hub")
              .withColumn("b", F.when(F.col("cls") == F.col("hub"), 0).otherwise(F.pmod(F.xxhash64("cls", "hub"), "blocks").cast("int"))))
    many = F.col("b") == 0
    first = placed.select(
        "hub", F.lit(0).alias("i"),
        F.explode(F.when(many & (F.col("blocks") > 1), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("b"))).alias("j"),
        "cls", F.lit(False).alias("main"))
    links = materialise(_links(first, sets, percent), "near")
    big = placed.where("blocks > 2")
    if big.limit(1).count():
        links = _across(big, links, sets, percent)
    roots = components(links).withColumnRenamed("node", "cls")
    # the smallest id of each component
    named = classes.select("set_id", "low_id", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = named.join(lowest, "root").select("set_id", F.col("root").alias("group"), "component_id")
    return (rows.join(named, "set_id", "left")
            .select(F.col("id").alias(id_col), "row_key", "n_shingles", "group",
                    F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def _across(big: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the remaining blocks of large gatherings.

    Only classes outside a gathering's largest component so far, the outsiders,
    are compared with all others. They and the main ones have blocks of their
    own: a main class goes to each block of outsiders, which is mostly one, and
    an outsider to each block of either kind.
    """
    comp = components(links).withColumnRenamed("node", "cls")
    m = big.join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    count = m.groupBy("hub", "root").agg(F.count("*").alias("n"))
    largest = count.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    m = m.join(largest.select("hub", F.col("m.root").alias("main_root")), "hub").withColumn("main", F.col("root") == F.col("main_root"))
    # block 0 has been compared with all
    m = m.where("b > 0").select("hub", "cls", "main").join(sets.select("cls", (F.octet_length("shingles") / 8).alias("n")), "cls")
    m = materialise(m, "rest")

    def blocks(of):
        return F.greatest(F.lit(1), F.ceil(F.sum(F.when(of, F.col("n"))) / BLOCK_SHINGLES).cast("int"))

    m = m.join(m.groupBy("hub").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("outs")), "hub")
    at = F.pmod(F.xxhash64("cls", "hub"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("outs"))).cast("int")
    m = m.withColumn("at", at)

    def upto(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    # (i, j) is block i of the outsiders with block j of the main ones, or with block -1 - j of the outsiders
    main = m.where("main").select("hub", F.explode(upto("outs")).alias("i"), F.col("at").alias("j"), "cls", "main")
    out = m.where("NOT main")
    own = out.select("hub", F.col("at").alias("i"), F.explode(upto("mains")).alias("j"), "cls", "main")
    other = (out.withColumn("other", F.explode(upto("outs"))).where("other <> at")
             .select("hub", F.least("at", "other").alias("i"), (-1 - F.greatest("at", "other")).alias("j"), "cls", "main"))
    more = _links(main.unionAll(own).unionAll(other), sets, percent)
    return materialise(links.unionAll(more), "near")
