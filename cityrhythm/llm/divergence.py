"""How far the sources of a language differ in their words, all pairs, all terms.

Counts of terms by group (language and source) are a sparse matrix. It is cut
into blocks of term buckets and of two tiles of groups; in a block a K-squared
quadtree keeps the quadrants that are not all zero. A pair of groups is compared
by going down both rows of the tree together: where both quadrants are zero the
price of each of their terms is the same number, so they are left at once and
priced by count; leaves where at least one is not zero are priced one by one.
All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import materialise

#: Groups of a tile, about, and cells of a block.
TILE, BLOCK_CELLS = 64, 100_000
#: Pairs of quadrants that are followed together.
FRONTIER = 1 << 18
SCALE, SMOOTH = 1_000_000_000, 2
#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_SECOND = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)[tx._LOWER]


def stretch_counts(buf: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[list[int], list[bytes], list[int], list[int]]:
    """Groups, terms, occurrences and texts with the term, for texts of the given groups."""
    s, e, h, first = tx.words(buf, off, LETTERS)
    if not len(s):
        return [], [], [], []
    low = tx._LOWER[buf]
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h2 = tx.spans_hash(buf, s, e, _SECOND)
    order = np.lexsort((text, h))
    a, b, t = h[order], h2[order], text[order]
    same = a[1:] == a[:-1]
    if (b[1:][same] != b[:-1][same]).any():     # two words of one hash: count them by their letters
        return _by_letters(low, s, e, text, group)
    at = np.flatnonzero(np.concatenate([[True], ~same | (t[1:] != t[:-1])]))
    n = np.diff(np.append(at, len(a)))
    h, word, g = a[at], order[at], group[t[at]]
    order = np.lexsort((g, h))
    h, word, g, n = h[order], word[order], g[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    word = word[at]
    return (g[at].tolist(), [low[x:y].tobytes() for x, y in zip(s[word].tolist(), e[word].tolist())],
            np.add.reduceat(n, at).tolist(), np.diff(np.append(at, len(h))).tolist())


def _by_letters(low: np.ndarray, s: np.ndarray, e: np.ndarray, text: np.ndarray, group: np.ndarray):
    per: dict[tuple[int, bytes], int] = {}
    for x, y, t in zip(s.tolist(), e.tolist(), text.tolist()):
        k = (t, low[x:y].tobytes())
        per[k] = per.get(k, 0) + 1
    out: dict[tuple[int, bytes], list[int]] = {}
    for (t, w), n in per.items():
        o = out.setdefault((int(group[t]), w), [0, 0])
        o[0] += n
        o[1] += 1
    return [g for g, _ in out], [w for _, w in out], [o[0] for o in out.values()], [o[1] for o in out.values()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: dict[tuple[str, str], int] = {}
        of = np.array([keys.setdefault(k, len(keys)) for k in zip(batch["lang"].to_pylist(), batch["source"].to_pylist())], np.int64)
        langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        for a, b, buf, off in tx.texts(batch["text"]):
            g, term, n, docs = stretch_counts(buf, off, of[a:b])
            at = pa.array(g, pa.int64())
            yield pa.record_batch([langs.take(at), sources.take(at), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                                   pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


class Tree:
    """K-squared quadtree of a sparse matrix: for each level the quadrants that are not all zero, and their children."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n_rows: int):
        side = max(n_rows, int(cols.max()) + 1 if len(cols) else 1, 2)
        self.depth = int(side - 1).bit_length()
        at = (rows.astype(np.int64) << 32) | cols
        self.order = np.argsort(at)     # leaves, by row and column
        level = at[self.order]
        self.children: list[np.ndarray] = []
        for _ in range(self.depth):
            r, c = level >> 32, level & 0xFFFFFFFF
            up = (r >> 1) << 32 | c >> 1
            parents, of = np.unique(up, return_inverse=True)
            child = np.full((len(parents) + 1, 4), -1, np.int32)    # the last row: an all-zero quadrant
            child[of, (r & 1) * 2 + (c & 1)] = np.arange(len(level))
            self.children.append(child)
            level = parents
        self.children.reverse()
        self.empty = len(rows) == 0


def compare(tree: Tree, price: np.ndarray, zero: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows the sum of prices at the columns where one of them is not zero, and the number of these columns.

    ``price`` holds the leaves' p in the tree's order, ``zero`` each row's p of
    a zero. With ``split`` > 0 only rows below it are paired with rows from it on.
    """
    n = len(zero)
    total, count = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    if tree.empty:
        return total, count
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, root.astype(np.int32), root.astype(np.int32))]
    while stack:
        level, r1, r2, n1, n2 = stack.pop()
        if level == tree.depth:
            keep = (r1 < r2) & (r2 < n)
            r1, r2, n1, n2 = r1[keep], r2[keep], n1[keep], n2[keep]
            p = np.where(n1 >= 0, price[n1], zero[r1])
            q = np.where(n2 >= 0, price[n2], zero[r2])
            np.add.at(total, (r1, r2), (p - q) ** 2 // (p + q))
            np.add.at(count, (r1, r2), 1)
            continue
        child, found = tree.children[level], []
        rest = tree.depth - level - 1   # bits of the row below the next level
        for d1 in (0, 1):
            for d2 in (0, 1):
                a, b = r1 * 2 + d1, r2 * 2 + d2
                ok = (a <= b) & ((b << rest) < n)
                if split:
                    ok &= ((a << rest) < split) & (((b + 1) << rest) > split)
                for dc in (0, 1):
                    m1, m2 = child[n1, d1 * 2 + dc], child[n2, d2 * 2 + dc]
                    k = np.flatnonzero(ok & ((m1 >= 0) | (m2 >= 0)))
                    found.append((a[k], b[k], m1[k], m2[k]))
        r1, r2, n1, n2 = (np.concatenate(x) for x in zip(*found))
        for i in range(0, len(r1), FRONTIER):
            stack.append((level + 1, r1[i:i + FRONTIER], r2[i:i + FRONTIER], n1[i:i + FRONTIER], n2[i:i + FRONTIER]))
    if split:
        total[split:, split:] = total[:split, :split] = 0
        count[split:, split:] = count[:split, :split] = 0
    return total, count


PARTIAL = "lang string, source string, other string, total long, terms long"


def _block(table: pa.Table) -> pa.Table:
    """Compare the groups of one block."""
    lang = table["lang"][0].as_py()
    ti, tj = table["ti"][0].as_py(), table["tj"][0].as_py()
    is_group = pa.compute.is_null(table["term"])
    groups = table.filter(is_group).sort_by([("tile", "ascending"), ("source", "ascending")])
    cells = table.filter(pa.compute.invert(is_group))
    names = groups["source"].combine_chunks()
    zero = groups["p"].to_numpy()
    split = 0 if ti == tj else int(pa.compute.sum(pa.compute.equal(groups["tile"], ti)).as_py() or 0)
    rows = pa.compute.index_in(cells["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    cols = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tree = Tree(rows, cols, len(names))
    total, count = compare(tree, cells["p"].to_numpy()[tree.order], zero, split)
    a, b = np.nonzero(count)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "other": names.take(pa.array(b)),
                     "total": pa.array(total[a, b], pa.int64()), "terms": pa.array(count[a, b], pa.int64())})


def _p(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (N + 2 V)), exact at any size; null where no term is kept."""
    up = f"CAST({SCALE} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(19,0)) + {SMOOTH})"
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + CAST(({up}) div (CAST({n} AS DECIMAL(19,0)) + {SMOOTH} * CAST({v} AS DECIMAL(19,0))) AS BIGINT) END")


_F = "(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """Each source's distance to every other of its language, and the terms that it has more often than its language.

    lang, source, part, item, value, rank (from 1 for each group and part, by
    value descending, then item). A language keeps the terms (runs of letters,
    A-Z lower-cased) that ``min_docs`` of its documents have. A group of N
    occurrences of the V kept terms gives each p = 1 + floor(10^9 (count + 2) /
    (N + 2 V)), a language likewise, and f = floor((p - q)^2 / (p + q)). ``pair``:
    the sum of f over all kept terms with each other source (0 if none is kept),
    all of them. ``term``: f of the group's terms with p above its language's q,
    the ``top`` largest.

    Null languages, sources and texts are ''. A group without terms has its
    pairs; a language of one source has none; an empty table gives no row. Rows
    are documents, so repeated rows count again. Other columns are not read.
    """
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))),
                      F.col(text_col).cast("binary").alias("text"))
    counts = materialise(src.mapInArrow(tx.trimmed(_count), "lang string, source string, term string, n long, docs long")
                         .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
            .select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "lang_n"))
    cells = materialise(counts.join(kept, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term")))
                        .select("lang", "source", "term", "n", "lang_n"), "cells")
    # the numbers of a group, and of a language over its terms
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    # a kept term's cells all carry its count in the language: taken once, at the term's least source
    terms = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    of_lang = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    groups = (src.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("cells", F.lit(0)).alias("cells")))
    groups = materialise(groups, "groups")
    size = groups.groupBy("lang").agg(F.count("*").alias("k"), F.sum("cells").alias("cells")).join(of_lang, "lang", "left")
    size = size.withColumn("tiles", F.ceil(F.col("k") / TILE).cast("int"))
    size = size.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("cells") * F.least(F.lit(2), F.col("tiles")) / F.col("tiles") / BLOCK_CELLS)).cast("int"))
    langs = materialise(size.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "tiles", "buckets"), "langs")
    groups = groups.join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")).withColumn("p", _p("0", "total", "v"))
    groups = materialise(groups.select("lang", "source", "total", "v", "lang_total", "tile", "tiles", "buckets", "p"), "groups")

    rows = cells.join(groups.withColumnRenamed("p", "zero"), ["lang", "source"])
    rows = rows.withColumn("p", _p("n", "total", "v")).withColumn("q", _p("lang_n", "lang_total", "v"))
    best = (rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_F.format(p="p", q="q")).alias("value")))
    best = _ranked(best).where(F.col("rank") <= top)

    here = ["lang", "source", "tile", "tiles", "p", "term", "bucket"]
    columns = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int")).select(*here)
    zeros = (groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).where("v > 0")
             .withColumn("term", F.lit(None).cast("string")).select(*here))
    dealt = (columns.unionByName(zeros).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("lang", F.least("tile", "to").alias("ti"), F.greatest("tile", "to").alias("tj"), "bucket", "tile", "source", "term", "p"))
    sums = (dealt.groupBy("lang", "ti", "tj", "bucket").applyInArrow(_block, PARTIAL)
            .groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"))
            .agg(F.sum("total").alias("sum"), F.sum("terms").alias("priced")))
    one, two = groups.select("lang", "source", "v", "p"), groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = one.join(two, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).drop("_lang")
    pairs = (pairs.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item")).join(sums, ["lang", "a", "b"], "left"))
    zero = F.coalesce(F.expr(_F.format(p="p", q="q")), F.lit(0)) * (F.col("v") - F.coalesce("priced", F.lit(0)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("sum", F.lit(0)) + zero).alias("value"))
    return _ranked(pairs).unionByName(best)


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(w).alias("rank"))
