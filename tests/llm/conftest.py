from __future__ import annotations

import pytest
from odd_documents import CLASHING, DOCS, odd_texts

from cityrhythm.llm import queries


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    queries.ready(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with a null id, a repeated row, one id with two texts, and columns of clashing names."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", None, "s0")[i % 4], i) for i, t in enumerate(odd_texts())]
    rows += [(None, odd_texts()[10], None, None, None), rows[12], (5, "another text of five", "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        df = df.selectExpr("*", f"cast('own {c}' as string) as `{c}`")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
