"""Plan inspection: the shape of a DataFrame's physical plan from ``explain``.

After an action the plan is AQE's final plan, so the summary shows what
actually ran: the Parquet scans with the columns they read and the filters
pushed into them, shuffles, reused exchanges, join strategies, windows and
top-k nodes.
"""

from __future__ import annotations

import contextlib
import io
import os
import re

from pyspark.sql import DataFrame


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def final_section(text: str) -> str:
    if "== Final Plan ==" in text:
        return text.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    return text


def summary(df: DataFrame) -> dict:
    """{scans: [(table, columns, pushed filters)], shuffles, reused, joins, windows, topk}."""
    text = formatted_plan(df)
    final = final_section(text)
    details = text.split("\n\n(1)", 1)[-1]
    final_ids = set(re.findall(r"Scan parquet\s+\((\d+)\)", final))
    scans = []
    for m in re.finditer(r"\((\d+)\) Scan parquet\s*\n(.*?)(?:\n\n|\Z)", "(1)" + details, re.S):
        if m.group(1) not in final_ids:
            continue
        block = m.group(2)
        loc = re.search(r"Location: \S+ \[(.*?)\]", block)
        table = os.path.basename(loc.group(1)).replace(".parquet", "") if loc else "?"
        pushed = re.search(r"PushedFilters: \[(.*?)\]\n", block)
        schema = re.search(r"ReadSchema: struct<(.*?)>", block)
        cols = [c.split(":")[0] for c in schema.group(1).split(",")] if schema and schema.group(1) else []
        scans.append((table, cols, pushed.group(1) if pushed else ""))
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin(?:\(skew=true\))?|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                       r"CartesianProduct) (\w+)", final)
    return {
        "scans": scans,
        "shuffles": len(re.findall(r"\+- Exchange \(|^Exchange \(", final, re.M)),
        "reused": len(re.findall(r"Reused", final)),
        "joins": sorted({f"{a} {b}" for a, b in joins}),
        "windows": len(re.findall(r"Window \(", final)),
        "topk": len(re.findall(r"TakeOrderedAndProject", final)),
    }
