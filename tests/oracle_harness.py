"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "TINYINT": "tinyint", "SMALLINT": "smallint",
                  "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


def _duck_type(t) -> str:
    return _DUCK_TO_SPARK.get(str(t), str(t))


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name, build, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    s_cols = sdf.columns
    res = {"name": name, "spark_rows": len(s_rows), "spark_s": round(t_spark, 3)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = dict(zip(d_cols, (_duck_type(t) for t in rel.types)))
    s_types = dict(sdf.dtypes)
    bad_types = {c: (s_types[c], d_types.get(c)) for c in s_cols if s_types[c] != d_types.get(c)}
    if bad_types:
        res["types"] = bad_types
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    exact = sorted([tuple(repr(r[i]) for i in sorted(range(len(s_cols)), key=lambda i: s_cols[i])) for r in s_rows]) == \
        sorted([tuple(repr(r[i]) for i in sorted(range(len(d_cols)), key=lambda i: d_cols[i])) for r in d_rows])
    res["exact"] = exact
    if a == b:
        res["status"] = "ok"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES differ (rows {len(a)} vs {len(b)}): {diff}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from cityrhythm.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]", shuffle_partitions=8)
    q, o = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(q)):
        try:
            r = compare(spark, name, q[name], o.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only") or r.get("types"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or q) - bad} passed / {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
