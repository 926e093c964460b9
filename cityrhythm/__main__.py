"""Command line: one sub-command per job, results written as Parquet tables.

    python -m cityrhythm validate FILE...                 exit 0 = complete, 1 = problem
    python -m cityrhythm autopsy FILE... [--line M2] [--bus-line 25G]
    python -m cityrhythm ingest --raw R --store S [YYYYMM ...] [--force] [--esik N]
    python -m cityrhythm rollup --store S
    python -m cityrhythm year 2023 --store S --out O
    python -m cityrhythm compare --store S --out O
    python -m cityrhythm special --store S --out O [--year 2023]
    python -m cityrhythm night-map 2023 --store S --out O --boundaries B.geojson
    python -m cityrhythm pulse-map 2023 --store S --out O --boundaries B.geojson

``--lookup stations.csv`` replaces the shipped M7 station table. The
conversion log defaults to ``<store>_log``. Master and cluster settings come
from the launcher (spark-submit); only an unset master defaults to local.
"""

from __future__ import annotations

import argparse
import sys

from cityrhythm import dims, reports


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cityrhythm", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)

    v = sub.add_parser("validate", help="validate raw monthly CSV files")
    v.add_argument("files", nargs="+")
    v.add_argument("--esik", type=int, default=dims.MIN_ROWS_PER_DAY, help="minimum rows per full day")

    a = sub.add_parser("autopsy", help="profile raw monthly CSV files (D1-D9)")
    a.add_argument("files", nargs="+")
    a.add_argument("--line", default="M2", help="rail line whose stations are listed (D6)")
    a.add_argument("--bus-line", default="25G", help="road line whose towns are listed (D6)")

    i = sub.add_parser("ingest", help="gate and convert new monthly CSV files")
    i.add_argument("months", nargs="*", help="YYYYMM tokens; all when empty")
    i.add_argument("--raw", required=True)
    i.add_argument("--store", required=True)
    i.add_argument("--log", default=None)
    i.add_argument("--force", action="store_true", help="skip the completeness gate")
    i.add_argument("--esik", type=int, default=dims.MIN_ROWS_PER_DAY, help="minimum rows per full day")

    def report(name, year=False, boundaries=False):
        r = sub.add_parser(name)
        if year:
            r.add_argument("year", type=int)
        r.add_argument("--store", required=True)
        r.add_argument("--out", required=True)
        r.add_argument("--lookup", default=None, help="station,district CSV (default: shipped M7 table)")
        r.add_argument("--no-rollup", action="store_true", help="read the rows instead of a persisted roll-up")
        if boundaries:
            r.add_argument("--boundaries", required=True, help="district boundaries GeoJSON")
        return r

    r = sub.add_parser("rollup", help="bring a store's hourly roll-up up to date")
    r.add_argument("--store", required=True)

    report("year", year=True)
    report("compare")
    report("special").add_argument("--year", type=int, default=2023)
    report("night-map", year=True, boundaries=True)
    report("pulse-map", year=True, boundaries=True)
    return p


def _session():
    from pyspark.sql import SparkSession

    from cityrhythm.session import build_session
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from pyspark import SparkConf
    master = SparkConf().get("spark.master", None)
    return build_session(None if master else "local[*]")


def _lookup(spark, path):
    from cityrhythm.sources.lookup import builtin_lookup, read_lookup
    return read_lookup(spark, path) if path else builtin_lookup(spark)


def _print(df, rows=None):
    """Print all rows of a report (one per file, day, mode or the like); returns them."""
    rows = df.collect() if rows is None else rows
    df.sparkSession.createDataFrame(rows, df.schema).show(max(1, len(rows)), truncate=False)
    return rows


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = _session()

    if args.cmd == "validate":
        from cityrhythm.operators import quality
        rep = quality.validate(spark, args.files, args.esik)
        # one row per file is fetched, once: the table and the exit code come from it
        rows = _print(rep.select("kaynak_dosya", "durum", "nedenler", "satir", "ilk_gun", "son_gun", "gun_sayisi", "ay_gun",
                                 "tam_gun", "kirik_gunler", "town_bos_pct", "hat_bos_pct", "yolcu_bos_pct"))
        return 0 if all(r["durum"] == quality.COMPLETE for r in rows) else 1

    if args.cmd == "autopsy":
        from cityrhythm.operators import autopsy, ingest
        from cityrhythm.sources import raw_csv
        import uuid

        from cityrhythm.session import work_path
        # parse the CSV once into a table in the shared checkpoint folder; the
        # profile tables below then scan columnar data instead of re-parsing
        stage = work_path(spark, f"autopsy/{uuid.uuid4().hex}")
        ingest.clean(raw_csv.read_raw(spark, args.files)).write.parquet(stage)
        rows = spark.read.parquet(stage)
        count, dtypes, sample = autopsy.overview(rows)
        count.show()
        print(dtypes)
        sample.show(truncate=False)
        for title, df in [
            ("coverage", autopsy.coverage_pairs(rows)),
            ("days", autopsy.day_profile(rows).orderBy("transition_date")),
            ("modes", autopsy.mode_map(rows, with_id=True).orderBy("transport_type_id")),
            ("towns", autopsy.town_count(rows)),
            ("top towns", autopsy.town_top(rows, 10)),
            (f"stations of {args.line}", autopsy.line_stations(rows, args.line, 8)),
            (f"towns of {args.bus_line}", autopsy.line_towns(rows, args.bus_line)),
            ("lines with blank town", autopsy.blank_town_lines(rows, 5)),
            ("passage vs passenger", autopsy.passage_vs_passenger(rows)),
            ("blank map by mode", autopsy.null_map(rows)),
        ]:
            print(f"== {title}")
            _print(df)
        return 0

    if args.cmd == "ingest":
        from cityrhythm.operators import ingest
        res = ingest.ingest(spark, args.raw, args.store, args.log or args.store.rstrip("/") + "_log",
                            months=args.months or None, min_rows=args.esik, force=args.force)
        _print(res.report.orderBy("yilay", "kaynak_dosya"))
        return 0

    if args.cmd == "rollup":
        from cityrhythm.plans import rollup
        path, months = rollup.update(spark, args.store)
        print(f"{path}: {len(months)} months written {months}")
        return 0

    lookup = _lookup(spark, args.lookup)
    use_rollup = not args.no_rollup
    if args.cmd == "year":
        paths = reports.year_report(spark, args.store, args.year, args.out, lookup, use_rollup=use_rollup)
    elif args.cmd == "compare":
        paths = reports.compare_years(spark, args.store, args.out, lookup, use_rollup=use_rollup)
    elif args.cmd == "special":
        paths = reports.special_report(spark, args.store, args.out, year=args.year, use_rollup=use_rollup)
    elif args.cmd == "night-map":
        paths = reports.night_map(spark, args.store, args.year, args.boundaries, args.out, lookup,
                                  use_rollup=use_rollup)
    else:
        paths = reports.pulse_map(spark, args.store, args.year, args.boundaries, args.out, lookup,
                                  use_rollup=use_rollup)
    for name, path in paths.items():
        print(f"{name}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
