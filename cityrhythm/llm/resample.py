"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target texts and one of all
raw texts, are bags of unigrams and bigrams (Xie et al., 2023). A document's
log weight is the sum of its n-grams' log ratios; Gumbel noise fixed by its id
is added, and the largest share is kept, which is sampling without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import materialise

U64 = np.uint64
BUCKETS = 1 << 14
#: Target documents that the target model is fitted on, at most (by a hash of their id).
MAX_TARGET = 20_000
_MARK = tx.NOT_SPACE & ~tx.ALNUM
_BINS, _FEW = 1024, 5_000


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and for each text how many come before it (one more at the end).

    Tokens are runs of letters and digits and runs of other marks, in their case.
    """
    s1, _, h1, _ = tx.words(buf, off, tx.ALNUM, tx.BYTE_EXACT)
    s2, _, h2, _ = tx.words(buf, off, _MARK, tx.BYTE_EXACT)
    s = np.concatenate([s1, s2])
    order = np.argsort(s, kind="stable")
    s, h = s[order], np.concatenate([h1, h2])[order]
    first = np.searchsorted(s, off, "left")
    two, at = tx.shingles(h, first, 2, short=False)
    place = np.concatenate([np.arange(len(h)), at])
    order = np.argsort(place, kind="stable")
    bucket = (np.concatenate([h, two])[order] % U64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(place[order], first, "left")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        is_target = batch["target"].to_numpy(zero_copy_only=False)
        for a, b, buf, off in tx.texts(batch["text"]):
            bucket, cut = ngrams(buf, off)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = np.repeat(is_target[a:b], np.diff(cut))
            target += np.bincount(bucket[own], minlength=BUCKETS)
    k = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])


def _weights(ratio):
    def run(text: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for a, b, buf, off in tx.texts(text):
            bucket, cut = ngrams(buf, off)
            total = np.concatenate([[0.0], np.cumsum(ratio.value[bucket])])
            out.append(total[cut[1:]] - total[cut[:-1]])
        return pa.array(np.concatenate(out), pa.float64())
    return run


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest value of a column of finite doubles, by narrowing histograms; k is 1 at least."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    above = 0       # values beyond hi
    while lo < hi:
        step = (hi - lo) / _BINS
        inside = df.where(F.col(col).between(lo, hi))
        b = F.least(F.floor((F.col(col) - lo) / step), F.lit(_BINS - 1)).alias("b") if step > 0 else F.lit(0).alias("b")
        bins = inside.groupBy(b).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("b")).collect()
        for r in bins:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] <= _FEW:
            own = df.where(F.col(col).between(r["lo"], r["hi"])).select(col).collect()
            return sorted((x[0] for x in own), reverse=True)[k - above - 1]
        if (lo, hi) == (r["lo"], r["hi"]):      # narrower than doubles can tell
            return lo
        lo, hi = r["lo"], r["hi"]
    return lo


def target_share(labels: DataFrame, labelled, is_target, id_col: str = "doc_id") -> float:
    """Target ids by labelled ids: the share of documents that belong to the target, as far as labels tell.

    ``labelled`` and ``is_target`` are conditions on ``labels``; null ids don't count, an id of several rows counts
    once, and is of the target if one of them is. Without labelled ids the share is 1, so that nothing goes unjudged.
    """
    ids = (labels.where(F.col(id_col).isNotNull()).groupBy(id_col)
           .agg(F.max(F.coalesce(labelled, F.lit(False))).alias("l"), F.max(F.coalesce(is_target, F.lit(False))).alias("t")))
    n, t = ids.where("l or t").agg(F.count("*"), F.count_if("t")).first()
    return t / n if n else 1.0


def resample(docs: DataFrame, target_ids: DataFrame, keep: float = 0.88, id_col: str = "doc_id", text_col: str = "text",
             seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: id_col, log_weight, gumbel_key, kept.

    ``target_ids`` (id_col) names the target documents; their model is fitted on
    ``MAX_TARGET`` of them at most, the raw model on all documents. The ``keep``
    share of rows with the largest keys is kept; rows tied with the last of
    them, which are repeated rows, are kept too. Null and empty texts have
    weight 0. Without target documents all weights are 0. Where labels tell, the
    share to keep is ``target_share``; a larger one keeps rows outside the target
    by construction, a smaller one drops rows of it.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    ids = (target_ids.select(F.col(id_col).alias("t")).where(F.col("t").isNotNull()).distinct()
           .orderBy(F.xxhash64("t"), "t").limit(MAX_TARGET))
    flagged = src.join(F.broadcast(ids), F.col("id") == F.col("t"), "left").select("text", F.col("t").isNotNull().alias("target"))
    got = (flagged.mapInArrow(tx.trimmed(_counts), "bucket int, raw long, target long").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    at = got["bucket"].to_numpy()
    raw[at] += got["raw"].to_numpy()
    target[at] += got["target"].to_numpy()
    raw /= raw.sum()
    # the target model is smoothed by the raw one, with the weight of one n-gram a bucket
    target = (target + BUCKETS * raw) / (target.sum() + BUCKETS)
    ratio = spark.sparkContext.broadcast(np.log(target / raw))
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    weight = F.arrow_udf(_weights(ratio), "double")
    rows = materialise(src.select("id", weight("text").alias("log_weight"))
                       .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(F.lit(0) + u))), "weights")
    n = rows.count()
    k = int(np.ceil(n * keep))
    least = kth_largest(rows, "gumbel_key", k) if k > 0 else float("inf")
    return rows.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("kept"))
