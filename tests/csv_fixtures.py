"""Hand-built raw monthly CSV files (FIXTURES.md §5)."""

from __future__ import annotations

import calendar
import datetime as dt
import os

from cityrhythm.schema import RAW_COLUMNS

MIN_ROWS = 30          # threshold used with these fixtures: 24 hours x 2 rows = 48 passes


def _row(day: dt.date, hour: int, town: str = "FATIH", passenger: str = "11", passage: str = "12",
         line_name: str = "M2", station: str = "S1") -> list[str]:
    return [day.isoformat(), f"{hour:02d}", "2", "RAYLI", "LINE X", "Normal", passage, passenger,
            "TAM", "Tam Kontur", town, line_name, station]


def month_rows(year: int, month: int, skip_days=(), short_days=(), crumb_days=(), per_hour: int = 2):
    """Rows of a month: every day 24 hours x ``per_hour`` rows, except
    ``skip_days`` (absent), ``short_days`` (hour 23 missing), ``crumb_days``
    (24 hours, one row each)."""
    rows = []
    for d in range(1, calendar.monthrange(year, month)[1] + 1):
        if d in skip_days:
            continue
        day = dt.date(year, month, d)
        hours = range(23) if d in short_days else range(24)
        n = 1 if d in crumb_days else per_hour
        for h in hours:
            for _ in range(n):
                rows.append(_row(day, h))
    return rows


def write_csv(raw_dir: str, yyyymm: str, rows: list[list[str]], header: list[str] | None = None,
              raw_lines: list[str] = ()) -> str:
    os.makedirs(raw_dir, exist_ok=True)
    path = os.path.join(raw_dir, f"hourly_transportation_{yyyymm}.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(header or RAW_COLUMNS) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
        for line in raw_lines:
            f.write(line + "\n")
    return path


def blank_lines(day: dt.date) -> list[str]:
    """Lines with blank variants in town / line_name / station and one NULL passenger."""
    d = day.isoformat()
    base = [d, "08", "2", "RAYLI", "LINE X", "Normal", "5", "5", "TAM", "Tam Kontur"]
    return [
        ",".join(base + ["  ", "M2", "S1"]),                 # spaces only
        ",".join(base + ["", "M2", "S1"]),                   # bare empty
        ",".join(base + ['""', "M2", "S1"]),                 # quoted empty
        ",".join(base + [" KADIKOY ", "M2", "S1"]),  # no-break spaces around
        ",".join(base + ["\tTAB", " M2 ", "S1"]),            # tab kept; padded line trimmed
        ",".join([d, "08", "2", "RAYLI", "LINE X", "Normal", "5", "", "TAM", "Tam Kontur", "FATIH", "M2", "S1"]),
    ]


def build_months(raw_dir: str) -> dict[str, str]:
    """The six-plus-one fixture months; returns yyyymm -> path."""
    out = {}
    out["202302"] = write_csv(raw_dir, "202302", month_rows(2023, 2))
    out["202303"] = write_csv(raw_dir, "202303", month_rows(2023, 3, skip_days=(15,)))
    out["202304"] = write_csv(raw_dir, "202304", month_rows(2023, 4, short_days=(10,)))
    out["202305"] = write_csv(raw_dir, "202305", month_rows(2023, 5, crumb_days=(20,)))
    stray = [_row(dt.date(2023, 7, 1), 0)]
    out["202306"] = write_csv(raw_dir, "202306", month_rows(2023, 6) + stray)
    swapped = list(RAW_COLUMNS)
    swapped[0], swapped[1] = swapped[1], swapped[0]
    rows7 = [[r[1], r[0]] + r[2:] for r in month_rows(2023, 7)]       # data follow the header
    out["202307"] = write_csv(raw_dir, "202307", rows7, header=swapped)
    out["202308"] = write_csv(raw_dir, "202308", month_rows(2023, 8), raw_lines=blank_lines(dt.date(2023, 8, 3)))
    missing = [c for c in RAW_COLUMNS if c != "line"]                       # a contract column is absent
    rows9 = [[v for c, v in zip(RAW_COLUMNS, r) if c != "line"] for r in month_rows(2023, 9)]
    out["202309"] = write_csv(raw_dir, "202309", rows9, header=missing)
    rows10 = [r + ["x"] for r in month_rows(2023, 10)]                       # an extra trailing column
    out["202310"] = write_csv(raw_dir, "202310", rows10, header=RAW_COLUMNS + ["ekstra"])
    return out
