"""District (rail) operators: night index family (C5, C13, C23, C24, C29,
C31) and hourly pulse family (C18, C19, C20).

District = ``COALESCE(town, lookup)`` over rail rows (B3); the town of road
rows is a depot area, so only rail is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityrhythm import dims
from cityrhythm.functions import is_night, per_mille, round_half_away
from cityrhythm.operators import P
from cityrhythm.operators.enrich import complete_district


def rail_districts(trips: DataFrame, lookup, rail: str = dims.RAIL,
                   m7_line: str = dims.M7_LINE) -> DataFrame:
    return complete_district(trips.where(F.col("road_type") == F.lit(rail)), lookup, m7_line)


def night_totals(trips: DataFrame, lookup: DataFrame, by: Sequence[str] = (),
                 rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """Per district: total, night total (NULL when no night row), per-mille."""
    r = rail_districts(trips, lookup, rail, m7_line).where(F.col("ilce").isNotNull())
    return (r.groupBy(*by, "ilce").agg(
                F.sum(P).alias("toplam"),
                F.sum(F.when(is_night("transition_hour"), F.col(P))).alias("gece"))
             .select(*by, "ilce", "toplam", "gece",
                     round_half_away(per_mille("gece", "toplam"), 1).alias("endeks")))


def night_index(trips: DataFrame, lookup: DataFrame, min_total: int = dims.NIGHT_INDEX_MIN_TOTAL,
                rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """District night index (per mille of rail passengers at 23:00-04:59)
    for districts with total > ``min_total``."""
    return (night_totals(trips, lookup, (), rail, m7_line).where(F.col("toplam") > F.lit(min_total))
            .select("ilce", F.col("toplam").alias("toplam_yolcu"), F.col("gece").alias("gece_yolcu"),
                    F.col("endeks").alias("gece_endeksi")))


def night_map_index(trips: DataFrame, lookup: DataFrame, min_total: int = dims.NIGHT_MAP_MIN_TOTAL,
                    rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """(ilce, endeks) for the map, threshold 500 000 by default."""
    return (night_totals(trips, lookup, (), rail, m7_line).where(F.col("toplam") > F.lit(min_total))
            .select("ilce", "endeks"))


def night_top(index: DataFrame, n: int = dims.NIGHT_TOP, value: str = "endeks") -> DataFrame:
    """The ``n`` highest indices (ties by district) — a top-k, not a sort."""
    return index.orderBy(F.col(value).desc_nulls_last(), F.col("ilce").asc()).limit(n)


def night_by_year(trips: DataFrame, lookup: DataFrame, min_total: int = dims.NIGHT_MAP_MIN_TOTAL,
                  rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """Night index per (year, district) with total > ``min_total``."""
    return (night_totals(trips, lookup, ("yil",), rail, m7_line).where(F.col("toplam") > F.lit(min_total))
            .select("yil", "ilce", F.col("endeks").alias("gece_endeksi"), "toplam"))


def night_by_year_top(trips: DataFrame, lookup, n: int = dims.BY_YEAR_TOP,
                      min_total: int = dims.NIGHT_MAP_MIN_TOTAL,
                      rail: str = dims.RAIL, m7_line: str = dims.M7_LINE,
                      latest_year: int | None = None) -> DataFrame:
    """C23 limited to the latest year's top-``n`` districts, rank carried.

    The latest year is that of the data (all modes, as the yearly files), not
    of the filtered result. One scan: all rows are summed per (year, rail
    district) — non-rail rows fall into a NULL-district group per year — so the
    latest year is the max over that small aggregate (years x districts rows),
    no second pass over the trips. Pass ``latest_year`` when it is known
    (e.g. from the partition listing).
    """
    r = complete_district(trips, lookup, m7_line)
    district = F.when(F.col("road_type") == F.lit(rail), F.col("ilce"))
    g = r.groupBy("yil", district.alias("ilce")).agg(
        F.sum(P).alias("toplam"),
        F.sum(F.when(is_night("transition_hour"), F.col(P))).alias("gece"))
    son = F.lit(latest_year) if latest_year is not None else F.max("yil").over(Window.partitionBy())
    x = (g.select("*", son.alias("_son_yil"))
         .where(F.col("ilce").isNotNull() & (F.col("toplam") > F.lit(min_total)))
         .select("yil", "ilce", round_half_away(per_mille("gece", "toplam"), 1).alias("gece_endeksi"),
                 "toplam", "_son_yil"))
    is_latest = F.col("yil") == F.col("_son_yil")
    # rank inside the latest year (one window partition per flag value; the
    # latest-year partition holds one row per district), then carry the rank
    # to the district's other years with a per-district window — no self-join.
    rn = F.row_number().over(Window.partitionBy(is_latest)
                             .orderBy(F.col("gece_endeksi").desc_nulls_last(), F.col("ilce").asc()))
    x = x.select("*", F.when(is_latest, rn).alias("_rn"))
    sira = F.max("_rn").over(Window.partitionBy("ilce"))
    return (x.select("yil", "ilce", "gece_endeksi", "toplam", sira.alias("sira"))
            .where(F.col("sira") <= n))


def index_scale(index: DataFrame, value: str = "endeks") -> DataFrame:
    """Linear position of each index between the min and max (NULL when
    they coincide, e.g. a single district)."""
    w = Window.partitionBy()        # one row per district
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return index.select("ilce", value, F.try_divide(F.col(value) - lo, hi - lo).alias("konum"))


# --- pulse ------------------------------------------------------------------

def _weekday_rail_daily(trips: DataFrame, lookup: DataFrame, rail: str, m7_line: str) -> DataFrame:
    r = rail_districts(trips.where(F.col("gun_tipi") == F.lit(dims.WEEKDAY)), lookup, rail, m7_line)
    return r.groupBy("transition_date", "ilce", "transition_hour").agg(F.sum(P).alias("yolcu"))


def top_towns_pulse(trips: DataFrame, lookup, n: int = dims.TOP_TOWNS,
                    rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """Weekday mean per (district, hour) for the top-``n`` towns by rail
    total over all days. The ranking uses the raw town (NULL -> 'X', which can
    take a slot), the means use the completed district.

    One scan: rail rows are summed once per (date, hour, day type, raw town,
    district) and both the ranking and the means are derived from that
    aggregate, whose shuffle AQE reuses. To keep the two branches identical
    below it, the weekday restriction is a conditional sum (not a filter), the
    district key is non-nullable (NULL -> a sentinel no town can equal) and the
    top-k is applied by an inner join after the last aggregation — none of
    which Catalyst pushes into only one branch.
    """
    base = (rail_districts(trips, lookup, rail, m7_line)
            .groupBy("transition_date", "transition_hour", "gun_tipi", "town",
                     F.coalesce(F.col("ilce"), F.lit(_NO_DISTRICT)).alias("_ilce"))
            .agg(F.sum(P).alias("yolcu")))
    top = (base.groupBy(F.coalesce(F.col("town"), F.lit("X")).alias("ilce"))
           .agg(F.sum("yolcu").alias("_t"))
           .orderBy(F.col("_t").desc(), F.col("ilce").asc()).limit(n)     # top-k, at most n rows
           .select("ilce"))
    daily = (base.groupBy("transition_date", "_ilce", "transition_hour")
             .agg(F.sum(F.when(F.col("gun_tipi") == F.lit(dims.WEEKDAY), F.col("yolcu"))).alias("yolcu"))
             .where(F.col("yolcu").isNotNull()))                          # weekday dates only
    means = daily.groupBy("_ilce", F.col("transition_hour").alias("saat")).agg(F.avg("yolcu").alias("ort_yolcu"))
    return means.join(top, F.col("_ilce") == F.col("ilce"), "inner").select("ilce", "saat", "ort_yolcu")


# a district key no town name can equal (stands for "no district"; names are
# upper-case transliterated text)
_NO_DISTRICT = "∅"


def pulse(trips: DataFrame, lookup: DataFrame, min_total: int = dims.PULSE_MIN_TOTAL,
          rail: str = dims.RAIL, m7_line: str = dims.M7_LINE) -> DataFrame:
    """C19 (long form): weekday mean per (district, hour) for districts whose
    weekday total > ``min_total``, and ``nabiz`` = mean / the district's max
    mean. Districts whose max is 0 are dropped."""
    daily = _weekday_rail_daily(trips, lookup, rail, m7_line).where(F.col("ilce").isNotNull())
    hourly = daily.groupBy("ilce", F.col("transition_hour").alias("saat")).agg(
        F.avg("yolcu").alias("ort"), F.sum("yolcu").alias("_s"))
    w = Window.partitionBy("ilce")  # <= 24 rows each
    x = hourly.select("ilce", "saat", "ort", F.sum("_s").over(w).alias("_tot"), F.max("ort").over(w).alias("_mx"))
    return (x.where((F.col("_tot") > F.lit(min_total)) & (F.col("_mx") > F.lit(0.0)))
            .select("ilce", "saat", "ort", (F.col("ort") / F.col("_mx")).alias("nabiz")))


def pulse_vectors(pulse_long: DataFrame) -> DataFrame:
    """C19 vector form: (ilce, nabiz array<double>[24]) with missing hours 0.

    Each district contributes at most 24 entries, so the per-group collection
    is bounded by the clock, not by the data.
    """
    m = pulse_long.groupBy("ilce").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("saat").cast("int"), F.col("nabiz")))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("_m")[h], F.lit(0.0)))
    return m.select("ilce", vec.alias("nabiz"))


def pulse_frames(pulse_long: DataFrame) -> DataFrame:
    """C20: animation frames as a table (saat, ilce, nabiz), 24 hours per district."""
    return (pulse_vectors(pulse_long)
            .select("ilce", F.posexplode("nabiz").alias("saat", "nabiz"))
            .select(F.col("saat").cast("tinyint").alias("saat"), "ilce", "nabiz"))
