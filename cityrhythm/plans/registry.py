"""Named queries: each maps (spark, sf_dir) -> DataFrame over the driver's
tables through a facade (FIXTURES.md §3), with an equivalent oracle SQL text
where one exists. Parameters are the facade's (see FIXTURES.md §4).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm import dims, model
from cityrhythm.operators import autopsy, cards, daily, districts, enrich, geo, ingest, profiles, quality, stations
from cityrhythm.plans import rollup
from cityrhythm.plans.oracle_sql import facade_sql
from cityrhythm.sources import raw_csv
from cityrhythm.sources.geojson import boundaries_of

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    survey_id: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, survey_id: str, sql: str | None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, survey_id, fn, sql, note)
        return fn
    return deco


def E(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    return model.facade_events(spark, sf_dir, year)


def O(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    return model.facade_orders(spark, sf_dir, year)


def LK(spark: SparkSession, sf_dir: str):
    return model.facade_lookup(spark, sf_dir)


def _boundaries(spark: SparkSession) -> DataFrame:
    """The fixture's few features as literal rows: executors need not have the file."""
    with open(BOUNDARIES, encoding="utf-8") as f:
        return boundaries_of(spark, f.read())


M7 = model.FACADE_M7_SEGMENT

# --- Fixed values: facade test parameters (FIXTURES.md §4) --------------------
FACADE_SPECIAL_DAYS = {
    1995: {"1995-02-06": "Kış fırtınası"},
    1996: {"1996-07-04": "Yaz şenliği"},
    1997: {"1997-10-29": "Cumhuriyet günü"},
    2050: {"2050-01-01": "Gelecek yılbaşı"},
}
FACADE_PERIODS = [
    dims.Period(1996, "1996-03-23", "1996-04-20", "1996-02-01", "1996-05-31", ("1996-04-21", "1996-04-25")),
    dims.Period(1997, "1997-03-11", "1997-04-09", "1997-02-01", "1997-05-31", ("1997-04-10", "1997-04-14")),
]
FACADE_DAY_MIN_ROWS = 300
FACADE_STATION_MIN_TOTAL = 10_000
FACADE_TOP_TOWNS = 4
FACADE_TOP = 3
FACADE_LINE = "BUILDING"
BOUNDARIES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                          "sources", "data", "facade_boundaries.geojson")

# SQL fragments shared by several oracle texts. A rounded value that can be
# negative gets "+ 0.0": Spark's round never returns -0.0, DuckDB's can.
NIGHT = "(transition_hour >= 23 OR transition_hour < 5)"
NIGHT_SUM = f"SUM(CASE WHEN {NIGHT} THEN number_of_passenger END)"
WDAY = f"gun_tipi = '{dims.WEEKDAY}'"
SPECIAL_SQL = "sd AS (SELECT * FROM (VALUES " + ", ".join(
    f"(DATE '{d}', '{lbl}')" for days in FACADE_SPECIAL_DAYS.values() for d, lbl in days.items()
) + ") v(tarih, etiket))"
PERIODS_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(
    f"({p.year}, DATE '{p.start}', DATE '{p.end}', DATE '{p.window_start}', DATE '{p.window_end}', "
    f"DATE '{p.excluded[0]}', DATE '{p.excluded[1]}')" for p in FACADE_PERIODS
) + ") v(yil, bas, son, pb, ps, hb, hs))"
MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in dims.MONTH_SHORT) + "]"
DAYS_SQL = "[" + ", ".join(f"'{d}'" for d in dims.WEEKDAY_SHORT) + "]"


def _pivot_sql(value: str, fill: str | None = None) -> str:
    cols = []
    for h in range(24):
        e = f"MAX(CASE WHEN saat = {h} THEN {value} END)"
        cols.append(f"COALESCE({e}, {fill}) AS h{h}" if fill else f"{e} AS h{h}")
    return ", ".join(cols)


# ---------------------------------------------------------------------------
# B1 / C1 / C3 / C6 / C8 / C9 / C21 / C22 — profiles
# ---------------------------------------------------------------------------

@register("rows_E", "B1", facade_sql("E", """
SELECT CAST(COUNT(*) AS BIGINT) AS satir, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
FROM trips WHERE yil = 2024"""))
def q_rows_e(spark, sf_dir):
    return E(spark, sf_dir, year=2024).agg(F.count(F.lit(1)).alias("satir"), F.sum("number_of_passenger").alias("yolcu"))


DAILY_HOUR_TYPE = """d AS (SELECT transition_date, gun_tipi, transition_hour AS saat,
  CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1, 2, 3)"""


@register("hourly_profile", "C1", facade_sql(
    "E", "SELECT gun_tipi, saat, ROUND(AVG(yolcu)) AS ortalama_yolcu FROM d GROUP BY 1, 2", [DAILY_HOUR_TYPE]))
def q_hourly_profile(spark, sf_dir):
    return profiles.hourly_profile(E(spark, sf_dir))


@register("hour_delta", "C3", facade_sql("E", """
SELECT saat, ROUND(ort) AS ort_yolcu, ROUND(ort - prev) + 0.0 AS onceki_saate_fark,
       ROUND(100.0::DOUBLE * (ort - prev) / NULLIF(prev, 0), 1) + 0.0 AS degisim_pct FROM l""", [
    f"""h AS (SELECT transition_hour AS saat,
  CAST(SUM(number_of_passenger) AS DOUBLE) / COUNT(DISTINCT transition_date) AS ort
  FROM trips WHERE {WDAY} GROUP BY 1)""",
    "l AS (SELECT saat, ort, LAG(ort) OVER (ORDER BY saat) AS prev FROM h)"]))
def q_hour_delta(spark, sf_dir):
    return profiles.hour_delta(E(spark, sf_dir))


@register("seasonal", "C6", facade_sql("O", """
SELECT ay, ROUND(ort) AS ort_gunluk_yolcu,
       ROUND(100.0::DOUBLE * ort / NULLIF(AVG(ort) OVER (), 0) - 100.0, 1) + 0.0 AS yil_ort_sapma_pct,
       ROUND(endeks, 1) AS gece_endeksi FROM m""", [
    f"""d AS (SELECT transition_date, ay, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu,
  CAST({NIGHT_SUM} AS BIGINT) AS gece FROM trips GROUP BY 1, 2)""",
    """m AS (SELECT ay, AVG(yolcu) AS ort,
  1000.0::DOUBLE * SUM(gece) / NULLIF(SUM(yolcu), 0) AS endeks FROM d GROUP BY 1)"""]))
def q_seasonal(spark, sf_dir):
    return profiles.seasonal(O(spark, sf_dir))


DOW_DAILY = """d AS (SELECT haftanin_gunu, transition_date, transition_hour AS saat,
  CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1, 2, 3)"""


@register("dow_hour", "C8", facade_sql("E", "SELECT haftanin_gunu, saat, AVG(yolcu) AS ort FROM d GROUP BY 1, 2",
                                       [DOW_DAILY]))
def q_dow_hour(spark, sf_dir):
    return profiles.dow_hour(E(spark, sf_dir))


@register("dow_hour_pivot", "C9,B6", facade_sql("E", f"""
SELECT haftanin_gunu, {DAYS_SQL}[haftanin_gunu] AS gun, {_pivot_sql('bin')}
FROM a GROUP BY 1""", [DOW_DAILY, "a AS (SELECT haftanin_gunu, saat, AVG(yolcu) / 1000.0 AS bin FROM d GROUP BY 1, 2)"]))
def q_dow_hour_pivot(spark, sf_dir):
    return profiles.dow_hour_pivot(E(spark, sf_dir))


@register("monthly_volume", "C21", facade_sql("O", "SELECT yil, ay, AVG(yolcu) AS ort_gunluk FROM d GROUP BY 1, 2", [
    """d AS (SELECT yil, ay, transition_date, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM trips GROUP BY 1, 2, 3)"""]))
def q_monthly_volume(spark, sf_dir):
    return profiles.monthly_volume(O(spark, sf_dir))


@register("hour_by_year", "C22", facade_sql("O", "SELECT yil, saat, AVG(yolcu) AS ort FROM d GROUP BY 1, 2", [
    f"""d AS (SELECT yil, transition_date, transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM trips WHERE {WDAY} GROUP BY 1, 2, 3)"""]))
def q_hour_by_year(spark, sf_dir):
    return profiles.hour_by_year(O(spark, sf_dir))


@register("calendar_O", "B2", facade_sql("O", """
SELECT DISTINCT transition_date, yil, ay, haftanin_gunu, gun_tipi FROM trips"""))
def q_calendar_o(spark, sf_dir):
    return O(spark, sf_dir).select("transition_date", "yil", "ay", "haftanin_gunu", "gun_tipi").distinct()


@register("years_O", "B4", facade_sql("O", "SELECT DISTINCT yil FROM trips"))
def q_years_o(spark, sf_dir):
    return enrich.available_years(O(spark, sf_dir))


@register("year_coverage_O", "B4", facade_sql("O", """
SELECT yil, COUNT(DISTINCT ay) AS ay_sayisi, MIN(transition_date) AS ilk_gun, MAX(transition_date) AS son_gun,
       COUNT(DISTINCT ay) < 12 AS kismi
FROM trips GROUP BY yil"""))
def q_year_coverage_o(spark, sf_dir):
    return enrich.year_coverage(O(spark, sf_dir))


# ---------------------------------------------------------------------------
# C4 / C10 / C11 / C12 — daily series
# ---------------------------------------------------------------------------

DAILY = "d AS (SELECT transition_date, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1)"


@register("moving_avg", "C4", facade_sql("O", """
SELECT transition_date, yolcu, ROUND(ma) AS hareketli_ort_7g,
       ROUND(100.0::DOUBLE * yolcu / NULLIF(ma, 0) - 100.0, 1) + 0.0 AS trendden_sapma_pct FROM m""", [
    DAILY, """m AS (SELECT transition_date, yolcu,
  AVG(yolcu) OVER (ORDER BY transition_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma FROM d)"""]))
def q_moving_avg(spark, sf_dir):
    return daily.moving_avg(O(spark, sf_dir))


ANOMALY_CTES = [
    """dz AS (SELECT transition_date, haftanin_gunu, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM trips GROUP BY 1, 2)""",
    """z0 AS (SELECT *, (yolcu - AVG(yolcu) OVER w) / NULLIF(STDDEV_SAMP(yolcu) OVER w, 0) AS zr
  FROM dz WINDOW w AS (PARTITION BY haftanin_gunu))""",
    "za AS (SELECT transition_date, haftanin_gunu, yolcu, ROUND(zr, 6) + 0.0 AS z, ABS(zr) >= 2.0 AS anomali FROM z0)",
]


@register("anomaly", "C10", facade_sql("O", "SELECT * FROM za", ANOMALY_CTES))
def q_anomaly(spark, sf_dir):
    return daily.anomaly(O(spark, sf_dir)).drop("z_ham")


def _facade_special(spark):
    """The facade's special days as a fixed mapping (all of them are marked)."""
    return {d: lbl for days in FACADE_SPECIAL_DAYS.values() for d, lbl in days.items()}


@register("anomaly_labels", "C11,B6", facade_sql("O", f"""
SELECT an.transition_date, an.haftanin_gunu, an.yolcu, an.z,
       COALESCE(sd.etiket, CASE WHEN x.transition_date IS NOT NULL
         THEN CAST(day(an.transition_date) AS VARCHAR) || ' ' || {MONTHS_SQL}[month(an.transition_date)] END) AS etiket
FROM an LEFT JOIN sd ON an.transition_date = sd.tarih
        LEFT JOIN x ON an.transition_date = x.transition_date""", ANOMALY_CTES + [
    "an AS (SELECT * FROM za WHERE anomali)", SPECIAL_SQL,
    "x AS (SELECT transition_date FROM an ORDER BY ABS(z) DESC, transition_date ASC LIMIT 6)"]))
def q_anomaly_labels(spark, sf_dir):
    return daily.anomaly_labels(O(spark, sf_dir), _facade_special(spark))


@register("series_annotations", "C12", facade_sql("O", """
SELECT d.transition_date, sd.etiket, d.yolcu FROM d JOIN sd ON d.transition_date = sd.tarih""", [DAILY, SPECIAL_SQL]))
def q_series_annotations(spark, sf_dir):
    return daily.series_annotations(O(spark, sf_dir), _facade_special(spark))


# ---------------------------------------------------------------------------
# C2 / C14 / C15 / C16-C17 — stations
# ---------------------------------------------------------------------------

@register("station_peak", "C2", facade_sql("E", """
SELECT hat, istasyon, saat AS zirve_saat, yolcu AS zirve_saat_yolcu, istasyon_toplam,
       ROUND(100.0::DOUBLE * yolcu / NULLIF(istasyon_toplam, 0), 1) AS zirve_pay_pct
FROM r WHERE sira = 1""", [
    f"""s AS (SELECT line_name AS hat, station_poi_desc_cd AS istasyon, transition_hour AS saat,
  CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
  WHERE road_type = 'RAYLI' AND station_poi_desc_cd IS NOT NULL AND {WDAY} GROUP BY 1, 2, 3)""",
    """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY hat, istasyon ORDER BY yolcu DESC, saat ASC) AS sira,
  CAST(SUM(yolcu) OVER (PARTITION BY hat, istasyon) AS BIGINT) AS istasyon_toplam FROM s)"""]))
def q_station_peak(spark, sf_dir):
    return stations.station_peak(E(spark, sf_dir), rail="RAYLI")


STATION_SHARE_CTES = [
    f"""g AS (SELECT line_name || ' / ' || station_poi_desc_cd AS istasyon, transition_hour AS saat,
  CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
  WHERE road_type = 'RAYLI' AND station_poi_desc_cd IS NOT NULL AND line_name IS NOT NULL AND {WDAY}
  GROUP BY 1, 2)""",
    "t AS (SELECT *, SUM(yolcu) OVER (PARTITION BY istasyon) AS tot FROM g)",
    f"ss AS (SELECT istasyon, saat, 1.0::DOUBLE * yolcu / NULLIF(tot, 0) AS pay FROM t WHERE tot > {FACADE_STATION_MIN_TOTAL})",
]


def _station_share(spark, sf_dir):
    return stations.station_share(E(spark, sf_dir), rail="RAYLI", min_total=FACADE_STATION_MIN_TOTAL)


@register("station_share", "C14", facade_sql("E", "SELECT * FROM ss", STATION_SHARE_CTES))
def q_station_share(spark, sf_dir):
    return _station_share(spark, sf_dir)


@register("station_matrix", "C15", facade_sql(
    "E", f"SELECT istasyon, {_pivot_sql('pay', '0.0')} FROM ss GROUP BY 1", STATION_SHARE_CTES))
def q_station_matrix(spark, sf_dir):
    return stations.station_matrix(_station_share(spark, sf_dir))


@register("station_clusters", "C16,C17", None, "k-means best of 10 starts with its profiles as arrays; rows-only check")
def q_station_clusters(spark, sf_dir):
    clusters, _ = stations.cluster_stations(stations.station_matrix(_station_share(spark, sf_dir)))
    return clusters


CLUSTER_ROUNDS, CLUSTER_STARTS, CLUSTER_K = 12, 10, 4


def _cluster_ctes() -> list[str]:
    """K-means as the operator defines it, a round a step: ``fit`` has each station's cluster in the best start."""
    hours = [f"h{h}" for h in range(24)]
    gap = " + ".join(f"(x.{h} - c.{h}) * (x.{h} - c.{h})" for h in hours)
    cols = ", ".join(hours)
    out = STATION_SHARE_CTES + [
        f"x AS MATERIALIZED (SELECT istasyon, {_pivot_sql('pay', '0.0')} FROM ss GROUP BY 1)",
        f"""f0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('42:' || istasyon), istasyon) - 1 AS start, 0 AS k, {cols} FROM x
          QUALIFY start < {CLUSTER_STARTS})"""]
    for j in range(1, CLUSTER_K):
        out += [f"""n{j} AS (SELECT * FROM (SELECT c.start, x.istasyon, min({gap}) AS d FROM x, f{j - 1} c GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY start ORDER BY d DESC, istasyon DESC) = 1)""",
                f"""f{j} AS MATERIALIZED (SELECT * FROM f{j - 1}
          UNION ALL SELECT n.start, {j}, {', '.join('x.' + h for h in hours)} FROM n{j} n JOIN x USING (istasyon))"""]
    sums = ", ".join(f"CAST(CAST(sum(CAST(floor(x.{h} * 1e12 + 0.5) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / 1e12 AS {h}" for h in hours)
    centres = f"f{CLUSTER_K - 1}"
    for r in range(CLUSTER_ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT istasyon, c.start, c.k, {gap} AS d FROM x, {centres} c
          QUALIFY row_number() OVER (PARTITION BY istasyon, c.start ORDER BY d, c.k) = 1)""")
        if r < CLUSTER_ROUNDS:
            out.append(f"""c{r} AS MATERIALIZED (SELECT o.start, o.k, {', '.join(f'coalesce(n.{h}, o.{h}) AS {h}' for h in hours)} FROM {centres} o
          LEFT JOIN (SELECT a.start, a.k, {sums} FROM a{r} a JOIN x USING (istasyon) GROUP BY 1, 2) n USING (start, k))""")
            centres = f"c{r}"
    out += [f"cost AS (SELECT start, sum(CAST(floor(d * 1e15 + 0.5) AS HUGEINT)) AS cost FROM a{CLUSTER_ROUNDS} GROUP BY 1 ORDER BY 2, 1 LIMIT 1)",
            f"fit AS (SELECT istasyon, CAST(k AS INT) AS kume, CAST(cost AS DOUBLE) / 1e15 AS maliyet FROM a{CLUSTER_ROUNDS} JOIN cost USING (start))",
            f"""prof AS (SELECT kume, any_value(maliyet) AS maliyet, count(*) AS boyut, {sums} FROM fit JOIN x USING (istasyon) GROUP BY 1)""",
            f"""named AS (SELECT *, (h16 + h17 + h18 + h19) / NULLIF(h6 + h7 + h8 + h9, 0) AS oran,
              CAST(row_number() OVER (ORDER BY (h16 + h17 + h18 + h19) / NULLIF(h6 + h7 + h8 + h9, 0) NULLS LAST, kume) AS INT) AS sira,
              [{', '.join(repr(n) for n in dims.CLUSTER_NAMES)}][sira] AS kume_adi FROM prof)"""]
    return out


def _clusters(spark, sf_dir):
    return stations.cluster_stations(stations.station_matrix(_station_share(spark, sf_dir)), k=CLUSTER_K, n_init=CLUSTER_STARTS, max_iter=CLUSTER_ROUNDS)


@register("station_cluster_profiles", "C16,C17", facade_sql(
    "E", f"SELECT kume_adi, sira, boyut, oran, {', '.join(f'h{h}' for h in range(24))}, maliyet FROM named", _cluster_ctes()))
def q_station_cluster_profiles(spark, sf_dir):
    return stations.cluster_profiles(_clusters(spark, sf_dir)[0])


@register("station_cluster_members", "C16,C17", facade_sql(
    "E", "SELECT istasyon, kume, kume_adi FROM fit JOIN named USING (kume)", _cluster_ctes()))
def q_station_cluster_members(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


# ---------------------------------------------------------------------------
# B3 / C5 / C13 / C23 / C24 / C29 / C31 / C30 / C32 — districts at night
# ---------------------------------------------------------------------------

@register("night_index", "B3,C5", facade_sql("E", f"""
SELECT ilce, CAST(SUM(number_of_passenger) AS BIGINT) AS toplam_yolcu, CAST({NIGHT_SUM} AS BIGINT) AS gece_yolcu,
       ROUND(1000.0::DOUBLE * {NIGHT_SUM} / NULLIF(SUM(number_of_passenger), 0), 1) AS gece_endeksi
FROM rail WHERE ilce IS NOT NULL GROUP BY 1 HAVING SUM(number_of_passenger) > 1000000"""))
def q_night_index(spark, sf_dir):
    return districts.night_index(E(spark, sf_dir), LK(spark, sf_dir), m7_line=M7, rail="RAYLI")


NIGHT_MAP = f"""nm AS (SELECT ilce, ROUND(1000.0::DOUBLE * {NIGHT_SUM} / NULLIF(SUM(number_of_passenger), 0), 1) AS endeks
  FROM rail WHERE ilce IS NOT NULL GROUP BY 1 HAVING SUM(number_of_passenger) > 500000)"""


def _night_map(spark, sf_dir):
    return districts.night_map_index(E(spark, sf_dir), LK(spark, sf_dir), m7_line=M7, rail="RAYLI")


@register("night_map_index", "C29", facade_sql("E", "SELECT * FROM nm", [NIGHT_MAP]))
def q_night_map_index(spark, sf_dir):
    return _night_map(spark, sf_dir)


@register("night_top", "C13", facade_sql(
    "E", f"SELECT ilce, endeks FROM nm ORDER BY endeks DESC NULLS LAST, ilce ASC LIMIT {FACADE_TOP}", [NIGHT_MAP]))
def q_night_top(spark, sf_dir):
    return districts.night_top(_night_map(spark, sf_dir), FACADE_TOP)


@register("index_scale", "C31", facade_sql("E", """
SELECT ilce, endeks, (endeks - MIN(endeks) OVER ()) / NULLIF(MAX(endeks) OVER () - MIN(endeks) OVER (), 0) AS konum
FROM nm""", [NIGHT_MAP]))
def q_index_scale(spark, sf_dir):
    return districts.index_scale(_night_map(spark, sf_dir))


BOUNDARY_NAMES = ("Afrıca", "Amerıca", "Asıa", "Çengelköy")


@register("map_enrich", "B7,C30", facade_sql("E", f"""
SELECT bn.ad, bn.ilce, nm.endeks,
       CASE WHEN nm.endeks IS NULL THEN '{dims.NO_RAIL_TEXT}' ELSE '{dims.PER_MILLE}' || printf('%.1f', nm.endeks) END
         AS gece_endeksi
FROM bn LEFT JOIN nm ON bn.ilce = nm.ilce""", [
    NIGHT_MAP,
    "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in BOUNDARY_NAMES) + ") v(ad))",
    f"bn AS (SELECT ad, upper(translate(ad, '{dims.TR_FROM}', '{dims.TR_TO}')) AS ilce FROM b)"]))
def q_map_enrich(spark, sf_dir):
    return geo.map_enrich(_boundaries(spark), _night_map(spark, sf_dir))


NIGHT_BY_YEAR = f"""nb AS (SELECT yil, ilce,
  ROUND(1000.0::DOUBLE * {NIGHT_SUM} / NULLIF(SUM(number_of_passenger), 0), 1) AS gece_endeksi,
  CAST(SUM(number_of_passenger) AS BIGINT) AS toplam
  FROM rail WHERE ilce IS NOT NULL GROUP BY 1, 2 HAVING SUM(number_of_passenger) > 500000)"""


@register("night_by_year", "B3,C23", facade_sql("O", "SELECT * FROM nb", [NIGHT_BY_YEAR]))
def q_night_by_year(spark, sf_dir):
    return districts.night_by_year(O(spark, sf_dir), LK(spark, sf_dir), m7_line=M7, rail="RAYLI")


@register("night_by_year_top", "C24", facade_sql("O", f"""
SELECT nb.yil, nb.ilce, nb.gece_endeksi, nb.toplam, r.sira FROM nb JOIN r ON nb.ilce = r.ilce
WHERE r.sira <= {FACADE_TOP}""", [
    NIGHT_BY_YEAR,
    """r AS (SELECT ilce, CAST(ROW_NUMBER() OVER (ORDER BY gece_endeksi DESC NULLS LAST, ilce ASC) AS INTEGER) AS sira
  FROM nb WHERE yil = (SELECT MAX(yil) FROM trips))"""]))
def q_night_by_year_top(spark, sf_dir):
    return districts.night_by_year_top(O(spark, sf_dir), LK(spark, sf_dir), n=FACADE_TOP, m7_line=M7, rail="RAYLI")


# ---------------------------------------------------------------------------
# C18 / C19 / C20 / C32 — district pulse
# ---------------------------------------------------------------------------

@register("top_towns", "C18", facade_sql("E", """
SELECT ilce, saat, AVG(yolcu) AS ort_yolcu FROM d WHERE ilce IN (SELECT ilce FROM top) GROUP BY 1, 2""", [
    f"""top AS (SELECT COALESCE(town, 'X') AS ilce FROM trips WHERE road_type = 'RAYLI'
  GROUP BY 1 ORDER BY SUM(number_of_passenger) DESC, 1 ASC LIMIT {FACADE_TOP_TOWNS})""",
    f"""d AS (SELECT transition_date, ilce, transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM rail WHERE {WDAY} GROUP BY 1, 2, 3)"""]))
def q_top_towns(spark, sf_dir):
    return districts.top_towns_pulse(E(spark, sf_dir), LK(spark, sf_dir), n=FACADE_TOP_TOWNS, m7_line=M7, rail="RAYLI")


PULSE_CTES = [
    f"""pd AS (SELECT ilce, transition_date, transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM rail WHERE {WDAY} GROUP BY 1, 2, 3)""",
    "ph AS (SELECT ilce, saat, AVG(yolcu) AS ort, SUM(yolcu) AS s FROM pd WHERE ilce IS NOT NULL GROUP BY 1, 2)",
    """pw AS (SELECT *, SUM(s) OVER (PARTITION BY ilce) AS tot, MAX(ort) OVER (PARTITION BY ilce) AS mx FROM ph)""",
    "pl AS (SELECT ilce, saat, ort, ort / mx AS nabiz FROM pw WHERE tot > 100000 AND mx > 0)",
]


def _pulse(spark, sf_dir):
    return districts.pulse(E(spark, sf_dir), LK(spark, sf_dir), m7_line=M7, rail="RAYLI")


@register("pulse", "C19", facade_sql("E", "SELECT * FROM pl", PULSE_CTES))
def q_pulse(spark, sf_dir):
    return _pulse(spark, sf_dir)


@register("pulse_filled", "C19,C20", facade_sql("E", """
SELECT g.saat, g.ilce, COALESCE(pl.nabiz, 0.0) AS nabiz
FROM g LEFT JOIN pl ON pl.ilce = g.ilce AND pl.saat = g.saat""", PULSE_CTES + [
    "g AS (SELECT ilce, CAST(unnest(range(24)) AS TINYINT) AS saat FROM (SELECT DISTINCT ilce FROM pl))"]))
def q_pulse_filled(spark, sf_dir):
    return districts.pulse_frames(_pulse(spark, sf_dir))


RINGS_SQL = f"""rings AS (
  SELECT p.ad, upper(translate(p.ad, '{dims.TR_FROM}', '{dims.TR_TO}')) AS ilce,
         CAST(generate_subscripts(p.parcalar, 1) - 1 AS INTEGER) AS parca, unnest(p.parcalar)[1] AS halka,
         upper(translate(p.ad, '{dims.TR_FROM}', '{dims.TR_TO}')) IN (SELECT ilce FROM pl) AS canli
  FROM (
    SELECT json_extract_string(feat, '$.properties.name') AS ad,
           CASE WHEN json_extract_string(feat, '$.geometry.type') = 'Polygon'
                THEN [json_transform(json_extract(feat, '$.geometry.coordinates'), '"DOUBLE[][][]"')]
                ELSE json_transform(json_extract(feat, '$.geometry.coordinates'), '"DOUBLE[][][][]"') END AS parcalar
    FROM (SELECT unnest(json_extract(content::JSON, '$.features[*]')) AS feat
          FROM read_text('{BOUNDARIES}'))
  ) p)"""


@register("map_rings", "C32", facade_sql("E", """
SELECT ad, ilce, parca, canli, CAST(len(halka) AS INTEGER) AS nokta,
       array_to_string(list_transform(halka, lambda q: printf('%.6f %.6f', q[1], q[2])), ', ') AS halka
FROM rings""", [*PULSE_CTES, RINGS_SQL]))
def q_map_rings(spark, sf_dir):
    return geo.ring_texts(geo.outer_rings(_boundaries(spark), _pulse(spark, sf_dir)))


@register("map_ring_points", "C32", facade_sql("E", """
SELECT ad, ilce, parca, CAST(generate_subscripts(halka, 1) - 1 AS INTEGER) AS sira,
       unnest(halka)[1] AS x, unnest(halka)[2] AS y, canli
FROM rings""", [*PULSE_CTES, RINGS_SQL]))
def q_map_ring_points(spark, sf_dir):
    return geo.ring_points(geo.outer_rings(_boundaries(spark), _pulse(spark, sf_dir)))


# ---------------------------------------------------------------------------
# C7 / C25 / C26 / C27 / C28 — cards and periods
# ---------------------------------------------------------------------------

@register("card_share", "C7", facade_sql("E", """
SELECT kart, saat, yolcu, ROUND(100.0::DOUBLE * yolcu / NULLIF(SUM(yolcu) OVER (PARTITION BY kart), 0), 2)
       AS gun_ici_pay_pct FROM g""", [
    f"""g AS (SELECT product_kind AS kart, transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu
  FROM trips WHERE {WDAY} AND product_kind IN ({", ".join(f"'{k}'" for k in model.FACADE_E_CARD_KINDS)})
  GROUP BY 1, 2)"""]))
def q_card_share(spark, sf_dir):
    return cards.card_share(E(spark, sf_dir), model.FACADE_E_CARD_KINDS)


@register("period_share", "C25", facade_sql("O", """
SELECT donem, saat, 100.0::DOUBLE * yolcu / NULLIF(SUM(yolcu) OVER (PARTITION BY donem), 0) AS pay FROM g""", [
    f"""g AS (SELECT CASE WHEN ay = 3 THEN '{dims.SCHOOL_LABEL}' ELSE '{dims.SUMMER_LABEL}' END AS donem,
  transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
  WHERE {WDAY} AND product_kind = '{model.FACADE_O_STUDENT_CARD}' AND ay IN (3, 7) GROUP BY 1, 2)"""]))
def q_period_share(spark, sf_dir):
    return cards.period_share(O(spark, sf_dir), card=model.FACADE_O_STUDENT_CARD)


_P97 = FACADE_PERIODS[1]


@register("period_profile", "C26", facade_sql("O", "SELECT donem, saat, AVG(yolcu) AS ort FROM g GROUP BY 1, 2", [
    f"""g AS (SELECT CASE WHEN transition_date BETWEEN DATE '{_P97.start}' AND DATE '{_P97.end}'
    THEN '{dims.RAMADAN_LABEL}' ELSE '{dims.NORMAL_LABEL}' END AS donem,
  transition_date, transition_hour AS saat, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
  WHERE yil = {_P97.year} AND {WDAY}
    AND transition_date BETWEEN DATE '{_P97.window_start}' AND DATE '{_P97.window_end}'
    AND transition_date NOT BETWEEN DATE '{_P97.excluded[0]}' AND DATE '{_P97.excluded[1]}'
  GROUP BY 1, 2, 3)"""]))
def q_period_profile(spark, sf_dir):
    return cards.period_profile(O(spark, sf_dir), _P97)


LIFT_CTES = [
    PERIODS_SQL,
    f"""g AS (SELECT t.yil, CASE WHEN t.transition_date BETWEEN p.bas AND p.son THEN 'ramazan' ELSE 'normal' END AS donem,
  t.transition_date, t.transition_hour AS saat, CAST(SUM(t.number_of_passenger) AS BIGINT) AS yolcu
  FROM trips t JOIN p ON t.yil = p.yil
  WHERE t.{WDAY} AND t.transition_date BETWEEN p.pb AND p.ps AND t.transition_date NOT BETWEEN p.hb AND p.hs
  GROUP BY 1, 2, 3, 4)""",
    "o AS (SELECT yil, donem, saat, AVG(yolcu) AS ort FROM g GROUP BY 1, 2, 3)",
    """lift AS (SELECT r.yil, r.saat, 100.0 * (r.ort / n.ort - 1) AS fark_pct FROM o r JOIN o n USING (yil, saat)
  WHERE r.donem = 'ramazan' AND n.donem = 'normal' AND (r.saat >= 20 OR r.saat <= 5))""",
]


def _lift(spark, sf_dir):
    return cards.period_lift(O(spark, sf_dir), FACADE_PERIODS)


@register("period_lift", "B5,C26,C27", facade_sql("O", "SELECT * FROM lift", LIFT_CTES))
def q_period_lift(spark, sf_dir):
    return _lift(spark, sf_dir)


@register("evening_spine", "C28", facade_sql("O", """
SELECT sp.yil, sp.sira, sp.saat, lift.fark_pct FROM sp LEFT JOIN lift ON sp.yil = lift.yil AND sp.saat = lift.saat""",
    LIFT_CTES + ["sp AS (SELECT yil, CAST(generate_subscripts(hrs, 1) - 1 AS INTEGER) AS sira, "
                 "CAST(unnest(hrs) AS TINYINT) AS saat FROM (SELECT yil, ["
                 + ", ".join(str(h) for h in dims.EVENING_ORDER) + "] AS hrs FROM p))"]))
def q_evening_spine(spark, sf_dir):
    return cards.evening_spine(_lift(spark, sf_dir), [p.year for p in FACADE_PERIODS])


# ---------------------------------------------------------------------------
# A4 / A5 / A6 / A8 — quality measures on facade rows
# ---------------------------------------------------------------------------

@register("day_completeness", "A5", facade_sql("E", f"""
SELECT transition_date, COUNT(DISTINCT transition_hour) AS saat, COUNT(*) AS satir,
       COUNT(DISTINCT transition_hour) = 24 AND COUNT(*) >= {FACADE_DAY_MIN_ROWS} AS tam,
       COUNT(DISTINCT transition_hour) < 24 OR COUNT(*) < {FACADE_DAY_MIN_ROWS} AS kirik
FROM trips GROUP BY 1"""))
def q_day_completeness(spark, sf_dir):
    return autopsy.day_completeness(E(spark, sf_dir), FACADE_DAY_MIN_ROWS)


@register("day_completeness_merged", "A5", facade_sql("E", f"""
SELECT transition_date, COUNT(DISTINCT transition_hour) AS saat, COUNT(*) AS satir,
       COUNT(DISTINCT transition_hour) = 24 AND COUNT(*) >= {FACADE_DAY_MIN_ROWS} AS tam,
       COUNT(DISTINCT transition_hour) < 24 OR COUNT(*) < {FACADE_DAY_MIN_ROWS} AS kirik
FROM trips GROUP BY 1"""))
def q_day_completeness_merged(spark, sf_dir):
    """The days' states are taken for each mode and card kind, as for parts that come apart, and united."""
    parts = autopsy.day_state(E(spark, sf_dir), ["road_type", "product_kind"])
    return autopsy.completeness_of_states(autopsy.merge_states(parts), FACADE_DAY_MIN_ROWS)


@register("month_coverage", "A4", facade_sql("E", """
SELECT COUNT(*) AS satir, MIN(transition_date) AS ilk_gun, MAX(transition_date) AS son_gun,
       COUNT(DISTINCT transition_date) AS gun_sayisi,
       CAST(day(last_day(MIN(transition_date))) AS INTEGER) AS ay_gun,
       CAST(day(last_day(MIN(transition_date))) AS BIGINT) - COUNT(DISTINCT transition_date) AS eksik_gun
FROM trips"""))
def q_month_coverage(spark, sf_dir):
    return autopsy.month_coverage(E(spark, sf_dir))


@register("month_gate", "A6", facade_sql("E", """
SELECT CAST(COUNT(*) FILTER (WHERE tam) AS INTEGER) AS tam_gun,
       CAST(day(last_day(MIN(transition_date))) AS INTEGER) AS ay_gun,
       CAST(COUNT(*) FILTER (WHERE tam) AS INTEGER) = CAST(day(last_day(MIN(transition_date))) AS INTEGER) AS kabul
FROM dc""", [f"""dc AS (SELECT transition_date,
  COUNT(DISTINCT transition_hour) = 24 AND COUNT(*) >= {FACADE_DAY_MIN_ROWS} AS tam FROM trips GROUP BY 1)"""]))
def q_month_gate(spark, sf_dir):
    return autopsy.month_gate(E(spark, sf_dir), FACADE_DAY_MIN_ROWS)


def _blank(c: str) -> str:
    return f"({c} IS NULL OR TRIM({c}) = '')"


@register("null_rates", "A8", facade_sql("E", f"""
SELECT 100.0::DOUBLE * COUNT(*) FILTER (WHERE {_blank('town')}) / NULLIF(COUNT(*), 0) AS town_bos_pct,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE {_blank('line_name')}) / NULLIF(COUNT(*), 0) AS hat_bos_pct,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE number_of_passenger IS NULL) / NULLIF(COUNT(*), 0) AS yolcu_bos_pct,
       COUNT(*) FILTER (WHERE number_of_passenger IS NULL) AS yolcu_bos, COUNT(*) AS toplam
FROM trips"""))
def q_null_rates(spark, sf_dir):
    return autopsy.null_rates(E(spark, sf_dir))


@register("null_map", "A8,D9", facade_sql("E", f"""
SELECT road_type, COUNT(*) AS satir,
       COUNT(*) FILTER (WHERE {_blank('station_poi_desc_cd')}) AS istasyon_bos,
       COUNT(*) FILTER (WHERE {_blank('town')}) AS town_bos,
       COUNT(*) FILTER (WHERE {_blank('line_name')}) AS hat_bos
FROM trips GROUP BY 1"""))
def q_null_map(spark, sf_dir):
    return autopsy.null_map(E(spark, sf_dir))


# ---------------------------------------------------------------------------
# D2-D8 — autopsy
# ---------------------------------------------------------------------------

@register("coverage_pairs", "D2", facade_sql("E", """
SELECT MIN(transition_date) AS ilk_gun, MAX(transition_date) AS son_gun,
       COUNT(DISTINCT transition_date) AS gun_sayisi,
       COUNT(DISTINCT (transition_date, transition_hour)) AS dolu_kombinasyon,
       CAST(day(last_day(MIN(transition_date))) * 24 AS INTEGER) AS beklenen_kombinasyon
FROM trips"""))
def q_coverage_pairs(spark, sf_dir):
    return autopsy.coverage_pairs(E(spark, sf_dir))


@register("coverage_pairs_merged", "D2", facade_sql("E", """
SELECT line_name, MIN(transition_date) AS ilk_gun, MAX(transition_date) AS son_gun,
       COUNT(DISTINCT transition_date) AS gun_sayisi,
       COUNT(DISTINCT (transition_date, transition_hour)) AS dolu_kombinasyon,
       CAST(day(last_day(MIN(transition_date))) * 24 AS INTEGER) AS beklenen_kombinasyon
FROM trips GROUP BY 1"""))
def q_coverage_pairs_merged(spark, sf_dir):
    """Per line, from states of its modes and stations united."""
    parts = autopsy.day_state(E(spark, sf_dir), ["line_name", "road_type", "station_poi_desc_cd"])
    return autopsy.coverage_of_states(autopsy.merge_states(parts, ["line_name"]), ["line_name"])


@register("day_profile", "D3", facade_sql("E", """
SELECT transition_date, COUNT(DISTINCT transition_hour) AS dolu_saat, COUNT(*) AS satir,
       CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1"""))
def q_day_profile(spark, sf_dir):
    return autopsy.day_profile(E(spark, sf_dir))


@register("mode_map", "D4", facade_sql("E", """
SELECT road_type, COUNT(*) AS satir, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1"""))
def q_mode_map(spark, sf_dir):
    return autopsy.mode_map(E(spark, sf_dir))


@register("town_count", "D5", facade_sql("E", "SELECT COUNT(DISTINCT town) AS ilce_sayisi FROM trips"))
def q_town_count(spark, sf_dir):
    return autopsy.town_count(E(spark, sf_dir))


@register("town_top", "D5", facade_sql("E", f"""
SELECT town, COUNT(*) AS satir, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips GROUP BY 1
ORDER BY yolcu DESC NULLS LAST, town ASC NULLS LAST LIMIT {FACADE_TOP}"""))
def q_town_top(spark, sf_dir):
    return autopsy.town_top(E(spark, sf_dir), FACADE_TOP)


@register("line_stations", "D6", facade_sql("E", f"""
SELECT line_name, station_poi_desc_cd, town, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
WHERE line_name = '{FACADE_LINE}' GROUP BY 1, 2, 3
ORDER BY yolcu DESC NULLS LAST, station_poi_desc_cd ASC NULLS LAST, town ASC NULLS LAST LIMIT 8"""))
def q_line_stations(spark, sf_dir):
    return autopsy.line_stations(E(spark, sf_dir), FACADE_LINE, 8)


@register("blank_town_lines", "D7", facade_sql("E", f"""
SELECT road_type, line_name, COUNT(*) AS satir, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM trips
WHERE {_blank('town')} GROUP BY 1, 2
ORDER BY yolcu DESC NULLS LAST, road_type ASC NULLS LAST, line_name ASC NULLS LAST LIMIT 5"""))
def q_blank_town_lines(spark, sf_dir):
    return autopsy.blank_town_lines(E(spark, sf_dir), 5)


@register("passage_vs_passenger", "D8", facade_sql("E", """
SELECT CAST(SUM(number_of_passage) AS BIGINT) AS gecis, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu,
       COUNT(*) FILTER (WHERE number_of_passage <> number_of_passenger) AS farkli_satir, COUNT(*) AS toplam_satir
FROM trips"""))
def q_passage_vs_passenger(spark, sf_dir):
    return autopsy.passage_vs_passenger(E(spark, sf_dir))


# ---------------------------------------------------------------------------
# §4 hourly roll-up — the same sums from the roll-up as from the rows
# ---------------------------------------------------------------------------

@register("rollup_E", "§4", facade_sql("E", f"""
SELECT {", ".join(rollup.KEYS)}, CAST(SUM(number_of_passenger) AS BIGINT) AS number_of_passenger,
       CAST(SUM(number_of_passage) AS BIGINT) AS number_of_passage, COUNT(*) AS satir,
       COUNT(*) FILTER (WHERE number_of_passage <> number_of_passenger) AS farkli_satir
FROM trips GROUP BY ALL"""))
def q_rollup_e(spark, sf_dir):
    return rollup.hourly_rollup(E(spark, sf_dir)).select(
        *rollup.KEYS, "number_of_passenger", "number_of_passage", "satir", "farkli_satir")


@register("hourly_profile_rollup", "C1,§4", facade_sql(
    "E", "SELECT gun_tipi, saat, ROUND(AVG(yolcu)) AS ortalama_yolcu FROM d GROUP BY 1, 2", [DAILY_HOUR_TYPE]))
def q_hourly_profile_rollup(spark, sf_dir):
    return profiles.hourly_profile(rollup.hourly_rollup(E(spark, sf_dir)))


# ---------------------------------------------------------------------------
# A2 / A6 / A7 / D1 / D4 / D6 — the raw file's text columns, cleaned and judged
# ---------------------------------------------------------------------------

def _raw(t: DataFrame) -> DataFrame:
    """A facade's trips as the text columns of a raw file: hours of two digits,
    some texts blank or padded, some passenger counts missing (by the passage count)."""
    k = F.col("number_of_passage") % 5

    def padded(c: str):
        return F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" "), F.col(c), F.lit(" "))).otherwise(F.col(c))
    return t.select(
        F.col("transition_date").cast("string").alias("transition_date"),
        F.lpad(F.col("transition_hour").cast("string"), 2, "0").alias("transition_hour"),
        F.when(F.col("road_type") == "OTOYOL", "1").when(F.col("road_type") == "RAYLI", "2").otherwise("3").alias("transport_type_id"),
        "road_type", padded("line_name").alias("line"), F.lit("Normal").alias("transfer_type"),
        F.col("number_of_passage").cast("string").alias("number_of_passage"),
        F.when(k != 2, F.col("number_of_passenger").cast("string")).alias("number_of_passenger"),
        "product_kind", F.lit(" Tam ").alias("transaction_type_desc"), padded("town").alias("town"),
        padded("line_name").alias("line_name"), padded("station_poi_desc_cd").alias("station_poi_desc_cd"))


_PAD = "CASE number_of_passage % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || {0} || ' ' ELSE {0} END"
_TRIMMED = "NULLIF(TRIM(" + _PAD + "), '')"
RAW_SQL = f"""raw AS (
  SELECT transition_date, transition_hour,
         CAST(CASE road_type WHEN 'OTOYOL' THEN 1 WHEN 'RAYLI' THEN 2 ELSE 3 END AS TINYINT) AS transport_type_id,
         road_type, {_TRIMMED.format('line_name')} AS line, 'Normal' AS transfer_type,
         CAST(number_of_passage AS INTEGER) AS number_of_passage,
         CAST(CASE WHEN number_of_passage % 5 <> 2 THEN number_of_passenger END AS INTEGER) AS number_of_passenger,
         product_kind, ' Tam ' AS transaction_type_desc, {_TRIMMED.format('town')} AS town,
         {_TRIMMED.format('line_name')} AS line_name, {_TRIMMED.format('station_poi_desc_cd')} AS station_poi_desc_cd, yil, ay
  FROM trips)"""


@register("clean_rows", "A2", facade_sql("E", "SELECT * EXCLUDE (yil, ay) FROM raw", [RAW_SQL]), "E as raw text, cleaned")
def q_clean_rows(spark, sf_dir):
    return ingest.clean(_raw(E(spark, sf_dir)))


@register("row_count", "D1", facade_sql("E", "SELECT COUNT(*) AS satir_sayisi FROM trips"), "E")
def q_row_count(spark, sf_dir):
    return autopsy.overview(E(spark, sf_dir))[0]


@register("mode_map_with_id", "D4", facade_sql("E", """
SELECT transport_type_id, road_type, COUNT(*) AS satir, CAST(SUM(number_of_passenger) AS BIGINT) AS yolcu FROM raw GROUP BY 1, 2""",
                                               [RAW_SQL]), "E as raw text, cleaned")
def q_mode_map_with_id(spark, sf_dir):
    return autopsy.mode_map(ingest.clean(_raw(E(spark, sf_dir))), with_id=True)


@register("line_towns", "D6", facade_sql("E", f"""
SELECT line_name, line, town, COUNT(*) AS satir FROM raw WHERE line_name = '{FACADE_LINE}' GROUP BY 1, 2, 3""", [RAW_SQL]),
          "E as raw text, cleaned; line BUILDING")
def q_line_towns(spark, sf_dir):
    return autopsy.line_towns(ingest.clean(_raw(E(spark, sf_dir))), FACADE_LINE)


FACADE_VERDICT_MIN_ROWS = 25
VERDICT_CTES = [RAW_SQL, f"""per_day AS (
  SELECT yil * 100 + ay AS donem, transition_date AS d, COUNT(DISTINCT transition_hour) AS saat, COUNT(*) AS satir,
         SUM(CASE WHEN town IS NULL THEN 1 ELSE 0 END) AS town_bos, SUM(CASE WHEN line_name IS NULL THEN 1 ELSE 0 END) AS hat_bos,
         SUM(CASE WHEN number_of_passenger IS NULL THEN 1 ELSE 0 END) AS yolcu_bos
  FROM raw GROUP BY 1, 2)""", f"""per_month AS (
  SELECT donem, CAST(SUM(satir) AS BIGINT) AS satir, MIN(d) AS ilk_gun, MAX(d) AS son_gun, COUNT(*) AS gun_sayisi,
         CAST(day(last_day(MIN(d))) AS INTEGER) AS ay_gun,
         COUNT(*) FILTER (WHERE saat = 24 AND satir >= {FACADE_VERDICT_MIN_ROWS}) AS tam_gun,
         COUNT(*) FILTER (WHERE saat < 24 OR satir < {FACADE_VERDICT_MIN_ROWS}) AS kirik_gun,
         CAST(SUM(town_bos) AS BIGINT) AS town_bos, CAST(SUM(hat_bos) AS BIGINT) AS hat_bos, CAST(SUM(yolcu_bos) AS BIGINT) AS yolcu_bos
  FROM per_day GROUP BY 1)""", """judged AS (
  SELECT *, array_to_string(list_filter([CASE WHEN gun_sayisi < ay_gun THEN 'eksik_gun' END, CASE WHEN kirik_gun > 0 THEN 'kirik_gun' END,
         CASE WHEN yolcu_bos > 0 THEN 'null_yolcu' END], lambda x: x IS NOT NULL), ',') AS nedenler FROM per_month)"""]


@register("month_verdict", "A7", facade_sql("O", f"""
SELECT CAST(donem AS VARCHAR) AS donem, satir, ilk_gun, son_gun, gun_sayisi, ay_gun, tam_gun, kirik_gun, town_bos, hat_bos, yolcu_bos,
       nedenler, CASE WHEN nedenler = '' THEN '{quality.COMPLETE}' ELSE '{quality.PROBLEM}' END AS durum FROM judged""", VERDICT_CTES),
          "O as raw text, a file for each month; 25 rows a day")
def q_month_verdict(spark, sf_dir):
    t = O(spark, sf_dir)
    rows = _raw(t.where(F.col("transition_date").isNotNull()))
    month = F.date_format(F.col("transition_date").cast("date"), "yyyyMM").alias(raw_csv.FILE_NAME)
    stats = quality.file_stats(rows.select("*", month), FACADE_VERDICT_MIN_ROWS)
    out = quality.verdict(stats.withColumns({"sema_ok": F.lit(True), "adla_okunur": F.lit(True)}))
    return out.select(F.col(raw_csv.FILE_NAME).alias("donem"), "satir", "ilk_gun", "son_gun", "gun_sayisi", "ay_gun", "tam_gun", "kirik_gun",
                      "town_bos", "hat_bos", "yolcu_bos", F.array_join("nedenler", ",").alias("nedenler"), "durum")


# Facade and parameters per query (FIXTURES.md §4), shown in QUERIES.md.
_NOTES = {
    "rows_E": "E; year 2024 (timestamp range pushed to the scan)",
    "hourly_profile": "E", "hour_delta": "E", "seasonal": "O", "dow_hour": "E",
    "dow_hour_pivot": "E; h0..h23 in thousands, weekday names",
    "calendar_O": "O; distinct calendar rows", "years_O": "O", "year_coverage_O": "O; partial years flagged",
    "monthly_volume": "O", "hour_by_year": "O", "moving_avg": "O; 7-row frame",
    "anomaly": "O; NULL z when stddev is 0 or undefined",
    "anomaly_labels": "O; special days 1995-02-06, 1996-07-04, 1997-10-29, 2050-01-01; top 6 by |z|, ties by date",
    "series_annotations": "O; same special days, absent ones drop out",
    "station_peak": "E; ties to the earlier hour", "station_share": "E; station total > 10 000",
    "station_matrix": "E; missing hour 0", "station_clusters": "E; k-means k=4, best of 10 starts",
    "station_cluster_profiles": "E; k-means k=4, best of 10 starts, 12 rounds", "station_cluster_members": "E; the same",
    "night_index": "E; total > 1 000 000", "night_map_index": "E; total > 500 000",
    "night_top": "E; first 3, ties by district", "index_scale": "E; NULL when min = max",
    "map_enrich": "E; 4 boundary features from the shipped GeoJSON fixture",
    "night_by_year": "O; total > 500 000", "night_by_year_top": "O; first 3 of the latest year, rank carried",
    "top_towns": "E; top 4 by raw town ('X' for NULL), one scan", "pulse": "E; weekday total > 100 000",
    "pulse_filled": "E; 24 hours per district, missing 0", "map_rings": "E; outer rings as text, alive = in pulse",
    "map_ring_points": "E; ring vertices; oracle parses the GeoJSON independently",
    "card_share": "E; kinds view, click, signup, purchase", "period_share": "O; kind 1-URGENT, months 3 vs 7",
    "period_profile": "O; 1997 period", "period_lift": "O; 1996 and 1997 periods, hours >= 20 or <= 5",
    "evening_spine": "O; 10 hours x 2 years",
    "day_completeness": "E; full = 24 hours and >= 300 rows", "day_completeness_merged": "E; the same, from states by mode and kind",
    "coverage_pairs_merged": "E; per line, from states by mode and station", "month_coverage": "E",
    "month_gate": "E; threshold 300", "null_rates": "E", "null_map": "E",
    "coverage_pairs": "E", "day_profile": "E", "mode_map": "E", "town_count": "E",
    "town_top": "E; first 3, ties by town", "line_stations": "E; line BUILDING, first 8",
    "blank_town_lines": "E; first 5", "passage_vs_passenger": "E",
    "rollup_E": "E; the hourly roll-up itself", "hourly_profile_rollup": "E; C1 computed on the roll-up",
}
for _name, _note in _NOTES.items():
    if _name in REGISTRY:
        _spec = REGISTRY[_name]
        REGISTRY[_name] = QuerySpec(_spec.name, _spec.survey_id, _spec.build, _spec.sql, _note)


def queries() -> dict[str, Builder]:
    return {k: v.build for k, v in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}
