"""Hourly / daily / monthly profiles.

All follow the same rule: sum per day (and hour) first, then average over the
day-hours that have rows. Each is two aggregations; the first runs partial
aggregation before its shuffle, so what crosses the network is at most one row
per (map task, day, hour, key) whatever the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityrhythm import dims
from cityrhythm.functions import is_night, ratio, round_half_away
from cityrhythm.operators import P


def _weekday(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("gun_tipi") == F.lit(dims.WEEKDAY))


def hourly_profile(trips: DataFrame) -> DataFrame:
    """Mean passengers per (day type, hour), rounded."""
    daily = trips.groupBy("transition_date", "gun_tipi", "transition_hour").agg(F.sum(P).alias("yolcu"))
    return daily.groupBy("gun_tipi", F.col("transition_hour").alias("saat")).agg(
        round_half_away(F.avg("yolcu")).alias("ortalama_yolcu"))


def hour_delta(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weekday mean per hour (sum / distinct days) and the change from the
    previous hour row (LAG counts rows, so a missing hour shifts it). With
    ``by`` (e.g. a line or station) the series and the window are per entity."""
    h = _weekday(trips).groupBy(*by, F.col("transition_hour").alias("saat")).agg(
        (F.sum(P).cast("double") / F.count_distinct("transition_date")).alias("ort"))
    w = Window.partitionBy(*by).orderBy("saat")      # 24 rows per entity after aggregation
    prev = F.lag("ort").over(w)
    return h.select(
        *by, "saat",
        round_half_away(F.col("ort")).alias("ort_yolcu"),
        round_half_away(F.col("ort") - prev).alias("onceki_saate_fark"),
        round_half_away(ratio(F.col("ort") - prev, prev, 100.0), 1).alias("degisim_pct"),
    )


def seasonal(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per month the mean daily total, its % deviation from the unweighted
    mean of the months, and the night per-mille (ratio of sums). With ``by``
    every entity gets its own monthly series and mean."""
    daily = trips.groupBy(*by, "transition_date", "ay").agg(
        F.sum(P).alias("yolcu"),
        F.sum(F.when(is_night("transition_hour"), F.col(P))).alias("gece_yolcu"))
    monthly = daily.groupBy(*by, "ay").agg(
        F.avg("yolcu").alias("ort"),
        ratio(F.sum("gece_yolcu"), F.sum("yolcu"), 1000.0).alias("endeks"))
    w = Window.partitionBy(*by)        # <= 12 rows per entity
    return monthly.select(
        *by, "ay",
        round_half_away(F.col("ort")).alias("ort_gunluk_yolcu"),
        round_half_away(ratio(F.col("ort"), F.avg("ort").over(w), 100.0) - F.lit(100.0), 1)
        .alias("yil_ort_sapma_pct"),
        round_half_away(F.col("endeks"), 1).alias("gece_endeksi"),
    )


def dow_hour(trips: DataFrame) -> DataFrame:
    """Mean per (ISO weekday, hour) — the "personality of days"."""
    daily = trips.groupBy("haftanin_gunu", "transition_date", "transition_hour").agg(F.sum(P).alias("yolcu"))
    return daily.groupBy("haftanin_gunu", F.col("transition_hour").alias("saat")).agg(F.avg("yolcu").alias("ort"))


def hour_columns(prefix: str = "h") -> list[str]:
    return [f"{prefix}{h}" for h in range(24)]


def pivot_hours(df: DataFrame, key: str, value: str, fill: float | None = None) -> DataFrame:
    """Pivot a long (key, saat, value) table into 24 fixed hour columns h0..h23.

    The hour values are given, so no job is spent discovering them and the
    output schema is stable even when an hour is missing everywhere.
    """
    p = df.groupBy(key).pivot("saat", list(range(24))).agg(F.first(value))
    p = p.select(key, *[F.col(str(h)).alias(f"h{h}") for h in range(24)])
    if fill is not None:
        p = p.fillna(fill, subset=hour_columns())
    return p


def dow_hour_pivot(trips: DataFrame) -> DataFrame:
    """The 7 x 24 weekday-hour table in thousands, rows labelled by weekday name."""
    long = dow_hour(trips).select("haftanin_gunu", "saat", (F.col("ort") / F.lit(1000.0)).alias("bin"))
    wide = pivot_hours(long, "haftanin_gunu", "bin")
    return wide.select("haftanin_gunu", dims.weekday_name("haftanin_gunu").alias("gun"), *hour_columns())


def monthly_volume(trips: DataFrame) -> DataFrame:
    """Mean daily total per (year, month)."""
    daily = trips.groupBy("yil", "ay", "transition_date").agg(F.sum(P).alias("yolcu"))
    return daily.groupBy("yil", "ay").agg(F.avg("yolcu").alias("ort_gunluk"))


def hour_by_year(trips: DataFrame) -> DataFrame:
    """Weekday hourly profile per year."""
    daily = _weekday(trips).groupBy("yil", "transition_date", "transition_hour").agg(F.sum(P).alias("yolcu"))
    return daily.groupBy("yil", F.col("transition_hour").alias("saat")).agg(F.avg("yolcu").alias("ort"))
