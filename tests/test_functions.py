"""Column helpers checked against DuckDB on generated inputs
and the letter-folding normaliser against Python's str.translate (T15)."""

from __future__ import annotations

import duckdb
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from cityrhythm import dims
from cityrhythm.functions import blank_to_null, is_blank, normalize_name, round_half_away

SETTINGS = settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))

# values with few decimals produce exact decimal ties (x.xx5) — the hard case
finite = st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.integers(min_value=-10**7, max_value=10**7).map(lambda i: i / 1000.0),
    st.integers(min_value=-10**6, max_value=10**6).map(lambda i: i / 200.0),
)


@SETTINGS
@given(st.lists(finite, min_size=1, max_size=40), st.integers(min_value=0, max_value=6))
@example([1.005, 2.675, 0.125, -2.5, -0.0004, 12.25], 2)
def test_round_half_away_equals_duckdb_round(spark, xs, digits):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["r"] for r in df.select("i", round_half_away("x", digits).alias("r")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, float(x)) for i, x in enumerate(xs)])
    want = dict(con.execute(f"SELECT i, ROUND(x, {digits}) + 0.0 FROM t").fetchall())
    assert got == want


SPACES = ["\u0020", "\u00a0", "\u1680", "\u2000", "\u2005", "\u200a", "\u202f", "\u205f", "\u3000"]
KEPT = ["\t", "\n", "\r", "\u200b", "\ufeff"]
text = st.lists(st.sampled_from(SPACES + KEPT + ["a", "B", "ş", "İ", "-", "7"]), max_size=8).map("".join)


@SETTINGS
@given(st.lists(st.one_of(st.none(), text), min_size=1, max_size=30))
@example(["\t\u00a0\n", "\u00a0x\u00a0", "\u200b", "  "])     # space before a final newline stays
def test_blank_to_null_equals_duckdb_nullif_trim(spark, vals):
    rows = [(i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r["i"]: (r["b"], r["k"]) for r in
           df.select("i", blank_to_null("s").alias("b"), is_blank("s").alias("k")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {i: (b, k) for i, b, k in con.execute(
        "SELECT i, NULLIF(TRIM(s), ''), s IS NULL OR TRIM(s) = '' FROM t").fetchall()}
    assert got == want


@SETTINGS
@given(st.lists(st.text(alphabet="abcçğıiöşüCÇGĞIİOÖSŞUÜ kxyz", max_size=12), min_size=1, max_size=20))
def test_normalize_name_equals_python_folding(spark, names):
    table = str.maketrans(dims.TR_FROM, dims.TR_TO)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r["i"]: r["u"] for r in df.select("i", normalize_name("n").alias("u")).collect()}
    assert got == {i: n.translate(table).upper() for i, n in enumerate(names)}


def test_night_never_exceeds_total(spark):
    from cityrhythm.operators import districts
    from cityrhythm.plans import registry
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        for r in districts.night_totals(registry.E(spark, sf), registry.LK(spark, sf), m7_line=registry.M7).collect():
            assert r["gece"] is None or 0 <= r["gece"] <= r["toplam"]
            assert r["endeks"] is None or 0.0 <= r["endeks"] <= 1000.0
