"""Model enrichment: district completion (B3), year discovery (B4), period tagging."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm import dims, schema


def complete_district(trips: DataFrame, lookup: DataFrame | Mapping[str, str], m7_line: str = dims.M7_LINE,
                      out: str = "ilce") -> DataFrame:
    """``COALESCE(town, lookup.ilce)`` where the lookup applies to line M7 only.

    ``lookup`` is a DataFrame (istasyon, ilce), LEFT joined on station with the
    left-only predicate ``line_name = m7_line`` in the join condition (Catalyst
    broadcasts it from its statistics); a mapping is taken as such rows. Rows of
    other lines keep their town and never match, unmatched M7 stations and NULL
    stations stay NULL, and rows cannot multiply because the key is unique.
    """
    if isinstance(lookup, Mapping):
        lookup = trips.sparkSession.createDataFrame(list(lookup.items()), schema.LOOKUP_SCHEMA)
    lk = lookup.select(F.col("istasyon").alias("_lk_istasyon"), F.col("ilce").alias("_lk_ilce"))
    cond = (F.col("line_name") == F.lit(m7_line)) & (F.col("station_poi_desc_cd") == F.col("_lk_istasyon"))
    joined = trips.join(lk, cond, "left")
    return joined.select(*[F.col(c) for c in trips.columns],
                         F.coalesce(F.col("town"), F.col("_lk_ilce")).alias(out))


def available_years(trips: DataFrame) -> DataFrame:
    """The distinct years present (a handful of rows; bounded by the calendar)."""
    return trips.select("yil").distinct()


def year_coverage(trips: DataFrame) -> DataFrame:
    """Per year the months present, first and last day, and whether the
    year is partial (fewer than 12 months) — comparisons flag partial years."""
    return (trips.groupBy("yil").agg(
                F.count_distinct("ay").alias("ay_sayisi"),
                F.min("transition_date").alias("ilk_gun"),
                F.max("transition_date").alias("son_gun"))
            .withColumn("kismi", F.col("ay_sayisi") < 12))


def require_years(trips: DataFrame, at_least: int = 2) -> list[int]:
    """The sorted list of years; raises when fewer than ``at_least`` exist.

    Collects only the distinct years (bounded by the calendar, not the data).
    """
    years = sorted(r["yil"] for r in available_years(trips).collect() if r["yil"] is not None)
    if len(years) < at_least:
        raise ValueError(f"at least {at_least} years are required, found {years}")
    return years


def in_range(col: Column | str, start, end) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _day(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def _days(start, end) -> Iterable[dt.date]:
    a = _day(start)
    return (a + dt.timedelta(days=i) for i in range((_day(end) - a).days + 1))


def scan_ranges(windows: Iterable[tuple[dt.date, dt.date]], most: int = 16) -> list[tuple[dt.date, dt.date]]:
    """At most ``most`` ranges that hold all windows: overlapping ones united, then those with the least days between."""
    out: list[tuple[dt.date, dt.date]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + dt.timedelta(days=1):
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    gaps = sorted(range(1, len(out)), key=lambda i: (out[i - 1][1] - out[i][0], i))[:most - 1]      # the widest stay
    cuts = [0, *sorted(gaps), len(out)]
    return [(out[i][0], out[j - 1][1]) for i, j in zip(cuts, cuts[1:]) if i < j]


def period_days(spark: SparkSession, periods, special: str = "ramazan", normal: str = "normal") -> DataFrame:
    """The days that :func:`tag_periods` keeps, one row each: ``_gun``, ``_yil``, and the label.

    ``periods``: a list of :class:`dims.Period` or the period dimension as a DataFrame. A day outside its
    period's year is left out; where periods of a year overlap, a day that one keeps is kept, and is special
    if any has it in its range.
    """
    if not isinstance(periods, DataFrame):
        kept, marked = set(), set()
        for p in periods:
            out = set(_days(*p.excluded))
            kept |= {d for d in _days(p.window_start, p.window_end) if d.year == p.year and d not in out}
            marked |= {d for d in _days(p.start, p.end) if d.year == p.year}
        return spark.createDataFrame([(d, d.year, special if d in marked else normal) for d in sorted(kept)], "_gun date, _yil int, _donem string")
    each = periods.select(F.col("yil").cast("int").alias("_yil"), "baslangic", "bitis", "pencere_bas", "pencere_son", "haric_bas", "haric_son")

    def of(first: str, last: str) -> DataFrame:
        days = each.select("_yil", F.explode(F.sequence(first, last)).alias("_gun"), "haric_bas", "haric_son")
        return days.where(F.year("_gun") == F.col("_yil"))
    kept = of("pencere_bas", "pencere_son").where(~F.col("_gun").between(F.col("haric_bas"), F.col("haric_son"))).select("_gun", "_yil", F.lit(False).alias("m"))
    marked = of("baslangic", "bitis").select("_gun", "_yil", F.lit(True).alias("m"))
    both = kept.unionByName(marked).groupBy("_gun", "_yil").agg(F.bool_or("m").alias("m"), F.bool_or(~F.col("m")).alias("k"))
    return both.where("k").select("_gun", "_yil", F.when(F.col("m"), F.lit(special)).otherwise(F.lit(normal)).alias("_donem"))


def tag_periods(trips: DataFrame, periods, special: str = "ramazan",
                normal: str = "normal", out: str = "donem") -> DataFrame:
    """Keep each period year's analysis window minus its holiday range, and
    label every day inside the period as ``special`` and the rest ``normal``.
    Years without a period drop out.

    The periods become days, joined by day, so the plan has one size however
    many periods there are. Fixed periods also limit the scan: a few ranges of
    the date reach the Parquet files, and the list of their months prunes the
    partitions of year and month that a roll-up has.
    """
    d = F.col("transition_date")
    days = period_days(trips.sparkSession, periods if isinstance(periods, DataFrame) else list(periods), special, normal)
    if not isinstance(periods, DataFrame):
        periods = list(periods)
        if not periods:
            return trips.where(F.lit(False)).select("*", F.lit(normal).alias(out))
        months = sorted({x.year * 100 + x.month for p in periods for x in _days(p.window_start, p.window_end)})
        ranges = reduce(or_, (in_range(d, a, b) for a, b in scan_ranges([(_day(p.window_start), _day(p.window_end)) for p in periods])))
        trips = trips.where(ranges).where((F.col("yil") * 100 + F.col("ay")).isin(months))
    j = trips.join(days, (d == F.col("_gun")) & (F.col("yil") == F.col("_yil")))
    return j.select(*[F.col(c) for c in trips.columns], F.col("_donem").alias(out))
