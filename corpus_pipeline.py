"""From raw documents to a mixed training corpus, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again,
and its decisions take effect in what it returns. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm.llm import decontam, langid, linedup, minhash, mixing
from cityrhythm.llm import text as tx
from cityrhythm.llm.queries import ready, table
from cityrhythm.llm.store import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def matching(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the rows named by doc_id and row_key."""
    named = ids.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    return docs.join(named, docs["doc_id"].eqNullSafe(named["_id"]) & (tx.row_key(docs) == named["_key"]), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in no learned language or of noise go; a missing lang is filled in.

    The model is learned from all texts with a lang. A document goes that no language takes by more than half, or whose
    mean log probability a byte lies 12 standard deviations below that of its language's texts: other languages, random
    letters. The bound is wide, so that unusual texts of a learned language stay.
    """
    ready(spark)
    found = materialise(langid.predict(docs, langid.fit(docs), fit=True), "predicted")
    out = langid.unlike(found, spreads=12.0).where("lang_pred <> 'und' AND score > 0.5 AND NOT unlike")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one of them; n_chars follows the text. Documents left without any word go."""
    ready(spark)
    out = linedup.dedup_lines(docs, min_chars=40, min_docs=5)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (80 % of the 5-word shingles) stays.

    It is that with the smallest id (null ids come last), then the smallest row_key, and any one of
    rows that have both. Documents without a word are of no group and stay.
    """
    ready(spark)
    found = minhash.groups(docs, shingle=5, percent=80).where("group is not null")
    rows = materialise(found.groupBy("group", "doc_id", "row_key").agg(F.count("*").alias("n")), "groups")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    out = matching(docs, rows.join(first, "group").where(~stays), "left_anti")
    again = rows.where("n > 1")
    if again.limit(1).count():
        one = matching(out, again, "left_semi")
        one = one.withColumn("_row", tx.row_key(one)).dropDuplicates(["doc_id", "_row"]).drop("_row")
        out = matching(out, again, "left_anti").unionByName(one)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return matching(docs, found.where("contaminated"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slots in the mixture of sources."""
    ready(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Segmentation-marginalised language models can't be said in SQL.
ORACLE_SQL = None
