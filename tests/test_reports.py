"""Report jobs end to end: CSV months -> ingest -> report tables, with and
without the persisted hourly roll-up."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cityrhythm import dims, model
from cityrhythm.operators import ingest, profiles
from cityrhythm.plans import registry
from cityrhythm.sources.lookup import builtin_lookup
from cityrhythm import reports
from tests.csv_fixtures import MIN_ROWS, month_rows, write_csv


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("store"))
    raw = os.path.join(base, "raw")
    write_csv(raw, "202212", month_rows(2022, 12))
    write_csv(raw, "202302", month_rows(2023, 2))
    write_csv(raw, "202303", month_rows(2023, 3))
    clean = os.path.join(base, "clean")
    res = ingest.ingest(spark, raw, clean, os.path.join(base, "log"), min_rows=MIN_ROWS)
    assert res.accepted == [202212, 202302, 202303]
    return base, clean


@pytest.mark.parametrize("use_rollup", [True, False])
def test_year_report_tables(spark, store, use_rollup):
    base, clean = store
    out = os.path.join(base, f"year_{use_rollup}")
    paths = reports.year_report(spark, clean, 2023, out, builtin_lookup(spark), use_rollup=use_rollup, clusters=False)
    hp = spark.read.parquet(paths["saatlik_profil"])
    direct = profiles.hourly_profile(model.trips(spark, clean, 2023))
    assert sorted(map(tuple, hp.collect())) == sorted(map(tuple, direct.collect()))
    assert spark.read.parquet(paths["yillik_seyir"]).count() == 28 + 31
    assert spark.read.parquet(paths["gun_saat"]).count() == 7
    assert spark.read.parquet(paths["saatlik_degisim"]).count() == 24
    assert sorted(r["ay"] for r in spark.read.parquet(paths["mevsimsel_ritim"]).collect()) == [2, 3]
    with pytest.raises(ValueError):
        reports.year_report(spark, clean, 2019, os.path.join(base, "none"), builtin_lookup(spark))


def test_compare_special_and_maps(spark, store):
    base, clean = store
    cy = reports.compare_years(spark, clean, os.path.join(base, "cmp"), builtin_lookup(spark))
    cov = {r["yil"]: (r["ay_sayisi"], r["kismi"]) for r in spark.read.parquet(cy["yil_kapsami"]).collect()}
    assert cov == {2022: (1, True), 2023: (2, True)}
    mv = {(r["yil"], r["ay"]): r["ort_gunluk"] for r in spark.read.parquet(cy["aylik_hacim"]).collect()}
    assert mv == {(2022, 12): 48 * 11.0, (2023, 2): 48 * 11.0, (2023, 3): 48 * 11.0}
    sp = reports.special_report(spark, clean, os.path.join(base, "special"), year=2023)
    kt = spark.read.parquet(sp["kart_tipi"])
    assert kt.where(F.col("kart") == "TAM").count() == 24 and kt.first()["kart_adi"] == "Tam"
    with pytest.raises(KeyError):          # the fixture has no Ramadan-period data
        reports.special_report(spark, clean, os.path.join(base, "special_strict"), year=2023, strict=True)
    assert spark.read.parquet(sp["ramazan_gece_sirasi"]).count() == 20
    nm = reports.night_map(spark, clean, 2023, registry.BOUNDARIES, os.path.join(base, "map"), builtin_lookup(spark),
                           min_total=0)
    assert spark.read.parquet(nm["harita"]).count() == 4
    assert [r["ilce"] for r in spark.read.parquet(nm["gece_endeksi"]).collect()] == ["FATIH"]
    pm = reports.pulse_map(spark, clean, 2023, registry.BOUNDARIES, os.path.join(base, "gif"), builtin_lookup(spark),
                           min_total=0)
    frames = spark.read.parquet(pm["kareler"])
    assert frames.count() == 24 and frames.agg(F.max("nabiz")).first()[0] == 1.0


def test_reports_on_driver_data_equal_registered_queries(spark, tmpdir_path):
    """Facade O (orders, 1995-2001) written in the clean-store layout; the
    report path (store -> persisted roll-up -> tables) gives the same tables as
    the oracle-checked queries over the facade."""
    from cityrhythm import schema
    sf = "/root/testdata/sf0.01"
    o = registry.O(spark, sf)
    store = os.path.join(tmpdir_path, "store_o")
    (o.withColumn(schema.PERIOD_COL, (F.col("yil") * 100 + F.col("ay")).cast("int"))
      .drop("yil", "ay", "haftanin_gunu", "gun_tipi")
      .write.partitionBy(schema.PERIOD_COL).parquet(store))
    lk = registry.LK(spark, sf)
    dom = dims.Domain(rail="RAYLI", m7_line=registry.M7)
    cy = reports.compare_years(spark, store, os.path.join(tmpdir_path, "cmp"), lk, domain=dom)
    for table, query in [("aylik_hacim", "monthly_volume"), ("saatlik_profil_yillar", "hour_by_year"),
                         ("gece_endeksi_yillar", "night_by_year")]:
        got = sorted(map(tuple, spark.read.parquet(cy[table]).collect()))
        want = sorted(map(tuple, registry.REGISTRY[query].build(spark, sf).collect()))
        assert got == want, table
    yr = reports.year_report(spark, store, 1997, os.path.join(tmpdir_path, "y1997"), lk, domain=dom, clusters=False)
    want = sorted(map(tuple, profiles.hourly_profile(registry.O(spark, sf, year=1997)).collect()))
    assert sorted(map(tuple, spark.read.parquet(yr["saatlik_profil"]).collect())) == want


def test_trips_view_for_sql_users(spark, store):
    base, clean = store
    model.register_trips_view(spark, clean, 2023)
    got = spark.sql("""
        WITH d AS (SELECT transition_date, gun_tipi, transition_hour,
                          SUM(number_of_passenger) AS yolcu FROM yolculuk GROUP BY 1, 2, 3)
        SELECT gun_tipi, transition_hour AS saat, ROUND(AVG(yolcu)) AS ortalama_yolcu FROM d GROUP BY 1, 2""")
    want = profiles.hourly_profile(model.trips(spark, clean, 2023))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT COUNT(*) FROM yolculuk WHERE yil = 2022").first()[0] == 0


def test_kept_rollup_is_updated_by_month_and_prunes(spark, tmp_path):
    from cityrhythm.plans import rollup
    from cityrhythm.plans.inspect import formatted_plan
    raw_dir, clean, log = (str(tmp_path / x) for x in ("raw", "store", "log"))
    for m in (1, 2):
        write_csv(raw_dir, f"20230{m}", month_rows(2023, m))
    ingest.ingest(spark, raw_dir, clean, log, min_rows=MIN_ROWS)
    path, first = rollup.update(spark, clean)
    assert path == clean + "_rollup" and first == [202301, 202302]
    assert rollup.update(spark, clean)[1] == []
    write_csv(raw_dir, "202203", month_rows(2022, 3))
    ingest.ingest(spark, raw_dir, clean, log, min_rows=MIN_ROWS)
    assert rollup.update(spark, clean)[1] == [202203]
    rows, kept = model.trips(spark, clean), rollup.kept(spark, clean)
    total = "sum(number_of_passenger)", "min(transition_date)", "max(transition_date)"
    assert kept.selectExpr(*total).first() == rows.selectExpr(*total).first()
    assert kept.selectExpr("sum(satir)").first()[0] == rows.count()
    p = formatted_plan(rollup.kept(spark, clean, 2022))
    assert "PartitionFilters" in p and "yilay" in p.split("PartitionFilters")[1].split("\n")[0]
    p = formatted_plan(kept.where("yil = 2022 and ay = 3"))
    assert "yil" in p.split("PartitionFilters")[1].split("\n")[0]
    assert kept.where("yil = 2022").count() == 31 * 24
