"""Write PLANS.md: the executed (post-AQE) physical plan shape of every
registered query at a given scale.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SKIP = "station_cluster"       # k-means: a job an iteration, not one plan


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from cityrhythm.plans.inspect import summary
    from cityrhythm.session import build_session
    spark = build_session("local[8]", app="cityrhythm-plans", shuffle_partitions=8)
    reg = __import__("cityrhythm.plans.registry", fromlist=["REGISTRY"]).REGISTRY
    print(f"# Executed plans at {os.path.basename(sf_dir)} (local[8], AQE on)\n")
    print("Generated by `scripts/plan_report.py`. Per query: the Parquet scans with the columns they read and the "
          "filters pushed into them, shuffle exchanges (after AQE), join strategies, windows and top-k nodes. "
          "`customer`/`nation`/`region` scans belong to the facades (FIXTURES §3); the fact scan is `events` "
          "or `orders`.\n")
    print("| query | SURVEY | scans (columns; pushed filters) | shuffles | reused | joins | windows | top-k |")
    print("|---|---|---|---|---|---|---|---|")
    for name, query in reg.items():
        if name.startswith(SKIP):
            continue
        df = query.build(spark, sf_dir)
        df.collect()
        s = summary(df)
        scans = "<br>".join(f"`{t}` ({', '.join(c)}{'; ' + p if p else ''})" for t, c, p in s["scans"])
        print(f"| {name} | {reg[name].survey_id} | {scans} | {s['shuffles']} | {s['reused']} | "
              f"{'<br>'.join(s['joins']) or '-'} | {s['windows']} | {s['topk']} |")
    spark.stop()


if __name__ == "__main__":
    main()
