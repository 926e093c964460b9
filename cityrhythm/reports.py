"""Report jobs: the data behind each of the reference's outputs, written as
Parquet tables (one folder per table) instead of charts.

* :func:`year_report`    — one year: hourly profile, hour-over-hour change,
  seasonal rhythm, weekday-hour table, yearly series with annotations,
  anomalies with labels, night districts, station peaks and clusters,
  district pulse (C1-C4, C6, C9-C18)
* :func:`compare_years`  — all years: year coverage (partial years flagged),
  monthly volume, weekday profile, night index by year limited to the latest
  year's leaders (B4, C21-C24)
* :func:`special_report` — card kinds (one year), student card school vs
  summer, Ramadan profile and lift, weekday personalities (C7, C8, C25-C28)
* :func:`night_map`      — night index per district joined to boundaries,
  colour-scale position (C29-C31)
* :func:`pulse_map`      — normalised district pulse, frames, outer rings (C19, C20, C32)

With ``use_rollup=True`` the reports read the store's hourly roll-up, kept
beside the store (``<store>_rollup``, see ``plans.rollup``): months that are new
or changed are aggregated first, all others are read as they are.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from cityrhythm import dims, model
from cityrhythm.operators import cards, daily, districts, enrich, geo, profiles, stations
from cityrhythm.plans import rollup as rollup_plan
from cityrhythm.sources.geojson import read_boundaries


def _scope(spark: SparkSession, clean_path: str, year: int | None, use_rollup: bool) -> DataFrame:
    """The trips of the scope: rows, or the store's kept roll-up, of which only
    months that changed are aggregated anew."""
    return rollup_plan.kept(spark, clean_path, year) if use_rollup else model.trips(spark, clean_path, year)


def _write(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Write each table to ``out_dir/<name>``. The writes are independent
    jobs (each reads the scope or its roll-up), so a few are submitted
    concurrently from driver threads."""
    paths = {name: os.path.join(out_dir, name) for name in tables}

    def write(name: str) -> None:
        tables[name].write.mode("overwrite").parquet(paths[name])

    with ThreadPoolExecutor(max_workers=min(4, max(1, len(tables)))) as pool:
        list(pool.map(write, tables))
    return paths


def year_report(spark: SparkSession, clean_path: str, year: int, out_dir: str,
                lookup: DataFrame | Mapping[str, str], domain: dims.Domain = dims.REAL,
                use_rollup: bool = True, clusters: bool = True) -> dict[str, str]:
    """The year figures. Raises when the year has no data."""
    t = _scope(spark, clean_path, year, use_rollup)
    if t.limit(1).count() == 0:
        raise ValueError(f"no data for {year}")
    sd = dims.special_days_map(domain.special_days, domain.series_labels, year=year)
    marked = dims.special_days_map(domain.special_days, domain.series_labels, year=year, marked_only=True)
    share = stations.station_share(t, domain.rail)
    out = {
        "saatlik_profil": profiles.hourly_profile(t),
        "saatlik_degisim": profiles.hour_delta(t),
        "mevsimsel_ritim": profiles.seasonal(t),
        "gun_saat": profiles.dow_hour_pivot(t),
        "yillik_seyir": daily.moving_avg(t),
        "seyir_etiketleri": daily.series_annotations(t, marked),
        "anomali": daily.anomaly(t),
        "anomali_etiketleri": daily.anomaly_labels(t, sd),
        "gece_ilceler": districts.night_top(districts.night_index(t, lookup, rail=domain.rail,
                                                                   m7_line=domain.m7_line),
                                            dims.NIGHT_TOP, value="gece_endeksi"),
        "istasyon_zirve": stations.station_peak(t, domain.rail),
        "istasyon_matrisi": stations.station_matrix(share),
        "ilce_nabiz": districts.top_towns_pulse(t, lookup, rail=domain.rail, m7_line=domain.m7_line),
    }
    paths = _write(out, out_dir)
    if clusters:
        matrix = spark.read.parquet(paths["istasyon_matrisi"])
        # with fewer stations than clusters there are as many clusters as distinct stations, and with none no rows
        kume, uyeler = (spark.createDataFrame([], t) for t in stations.CLUSTER_SCHEMAS) if matrix.isEmpty() else \
            stations.cluster_stations(matrix)
        paths.update(_write({"istasyon_kumeleri": kume, "istasyon_kume_uyeleri": uyeler}, out_dir))
    return paths


def compare_years(spark: SparkSession, clean_path: str, out_dir: str,
                  lookup: DataFrame | Mapping[str, str], domain: dims.Domain = dims.REAL,
                  use_rollup: bool = True) -> dict[str, str]:
    """The comparison across all years; at least two years are required."""
    t = _scope(spark, clean_path, None, use_rollup)
    enrich.require_years(t, 2)
    out = {
        "yil_kapsami": enrich.year_coverage(t),
        "aylik_hacim": profiles.monthly_volume(t),
        "saatlik_profil_yillar": profiles.hour_by_year(t),
        "gece_endeksi_yillar": districts.night_by_year(t, lookup, rail=domain.rail, m7_line=domain.m7_line),
        "gece_endeksi_yillar_top": districts.night_by_year_top(t, lookup, rail=domain.rail, m7_line=domain.m7_line),
    }
    return _write(out, out_dir)


def special_report(spark: SparkSession, clean_path: str, out_dir: str, year: int = 2023,
                   domain: dims.Domain = dims.REAL, use_rollup: bool = True,
                   strict: bool = False) -> dict[str, str]:
    """Card kinds and weekday personalities for ``year``; Ramadan over all years.

    ``strict`` raises when an evening hour of a period year has no lift value
    (the chart's fixed 20..05 order cannot be drawn with a gap)."""
    y = _scope(spark, clean_path, year, use_rollup)
    allt = _scope(spark, clean_path, None, use_rollup)
    periods = list(domain.ramadan)
    lift = cards.period_lift(allt, periods)
    out = {
        "kart_tipi": cards.card_share(y, domain.card_kinds).withColumn("kart_adi", dims.card_label("kart")),
        "ogrenci_donem": cards.period_share(y, domain.student_card),
        "ramazan_profil": cards.period_profile(allt, periods[-1]),
        "ramazan_fark": lift,
        "ramazan_gece_sirasi": cards.evening_spine(lift, [p.year for p in periods]),
        "gunlerin_kisiligi": profiles.dow_hour(y).withColumn("gun_adi", dims.weekday_name("haftanin_gunu", long=True)),
    }
    if strict:
        cards.assert_evening_complete(out["ramazan_gece_sirasi"])
    return _write(out, out_dir)


def night_map(spark: SparkSession, clean_path: str, year: int, boundaries_path: str, out_dir: str,
              lookup: DataFrame | Mapping[str, str], domain: dims.Domain = dims.REAL,
              use_rollup: bool = True, min_total: int = dims.NIGHT_MAP_MIN_TOTAL) -> dict[str, str]:
    t = _scope(spark, clean_path, year, use_rollup)
    idx = districts.night_map_index(t, lookup, min_total, rail=domain.rail, m7_line=domain.m7_line)
    b = read_boundaries(spark, boundaries_path)
    return _write({"gece_endeksi": idx, "harita": geo.map_enrich(b, idx),
                   "renk_olcegi": districts.index_scale(idx)}, out_dir)


def pulse_map(spark: SparkSession, clean_path: str, year: int, boundaries_path: str, out_dir: str,
              lookup: DataFrame | Mapping[str, str], domain: dims.Domain = dims.REAL,
              use_rollup: bool = True, min_total: int = dims.PULSE_MIN_TOTAL) -> dict[str, str]:
    t = _scope(spark, clean_path, year, use_rollup)
    p = districts.pulse(t, lookup, min_total, rail=domain.rail, m7_line=domain.m7_line)
    b = read_boundaries(spark, boundaries_path)
    return _write({"nabiz": p, "kareler": districts.pulse_frames(p),
                   "halkalar": geo.outer_rings(b, p)}, out_dir)
