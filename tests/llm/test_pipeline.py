"""The pipeline's stages and the registered queries on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cityrhythm.llm import queries
from cityrhythm.llm.store import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = benchmark.orderBy(F.length("text").desc()).first()["text"]
    more = odd.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 100_000)
    leaked = spark.createDataFrame([(200_000, f"Some words before. {leak} And some behind.", "en", "s0", 1)], docs.schema)
    shared = spark.createDataFrame([(300_000 + i, "Only one line, which six documents have, and nothing else.", "en", "s0", 1) for i in range(6)], docs.schema)
    noise = spark.createDataFrame([(400_000 + i, "xqz vbwk jjfh qqpt zxcv " * 20, None, "s0", 1) for i in range(3)], docs.schema)
    docs = materialise(docs.unionByName(more).unionByName(leaked).unionByName(shared).unionByName(noise), "test")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "test")
        rows[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = rows["language_id"]
    gone = before.select("doc_id", "text").exceptAll(after.select("doc_id", "text")).collect()
    assert before.where("doc_id >= 400000").count() == 3 and after.where("doc_id >= 400000").count() == 0
    gone = [r for r in gone if r.doc_id is None or r.doc_id < 400_000]
    assert gone and not any(c.isalpha() for r in gone for c in r.text or "")
    assert after.where("lang is null").count() == 0
    before, after = rows["line_dedup"]
    assert [r.doc_id for r in after.where("doc_id >= 300000").collect()] == [300_005]
    assert before.count() - after.count() == 5
    assert after.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
    before, after = rows["near_dedup"]
    assert before.where("doc_id in (100014, 100015)").count() == 2 and after.where("doc_id in (100014, 100015)").first().doc_id == 100014
    assert after.where("doc_id in (100014, 100015)").count() == 1 and after.where("doc_id in (100011, 100013)").count() == 0
    before, after = rows["decontaminate"]
    assert before.where("doc_id = 200000").count() == 1 and after.where("doc_id = 200000").count() == 0
    before, after = rows["mix_sources"]
    assert before.count() == after.count() and {"mix_slot", "mixed"} <= set(after.columns)


def test_one_document_of_a_group_stays(spark):
    """Also of exact repeats, of one id with two near-equal texts, and of groups whose ids are all null."""
    def text(k, end):
        return " ".join(f"{k}word{i}" for i in range(60)) + f" {end}"

    rows = [(1, text("a", "x"))] * 3 + [(2, text("a", "x"))] + [(5, text("b", "x")), (5, text("b", "y")), (6, text("b", "y"))]
    rows += [(None, text("c", "x"))] * 2 + [(None, text("c", "y"))] + [(None, text("d", "x")), (7, text("d", "y"))]
    rows += [(5, text("e", "x")), (8, text("e", "y")), (9, text("f", "x")), (10, " "), (10, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "a"), (5, "b"), (None, "c"), (7, "d"), (5, "e"), (9, "f"), (10, " "), (10, " "), (None, "")], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet/*.parquet')" if _is_folder(t) else
                    f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    exp = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in exp.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, exp.fetchall()))


def _is_folder(table: str) -> bool:
    import os
    return os.path.isdir(f"{SF}/{table}.parquet")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() > 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
