"""Ingest, gate, validation and incremental conversion (A1-A13) on CSV fixtures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cityrhythm import model, schema
from cityrhythm.operators import ingest, quality
from cityrhythm.plans.inspect import formatted_plan
from cityrhythm.sources import raw_csv, versioned
from tests.csv_fixtures import MIN_ROWS, build_months, month_rows, write_csv


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("raw"))
    return d, build_months(d)


def test_list_and_select_months(spark, raw):
    d, files = raw
    listed = raw_csv.list_month_files(spark, d)
    assert [raw_csv.month_of(f) for f in listed] == sorted(files)
    only = raw_csv.list_month_files(spark, d, ["202302", "202306"])
    assert [raw_csv.month_of(f) for f in only] == ["202302", "202306"]
    with pytest.raises(FileNotFoundError):
        raw_csv.list_month_files(spark, d, ["199901"])


def test_header_check(spark, raw):
    d, files = raw
    heads = {raw_csv.month_of(r[schema.SOURCE_COL]): r["sema_ok"]
             for r in raw_csv.check_headers(spark, list(files.values())).collect()}
    assert heads["202307"] is False and heads["202309"] is False and heads["202310"] is False
    assert all(v for k, v in heads.items() if k not in ("202307", "202309", "202310"))
    by_name = {raw_csv.month_of(r[schema.SOURCE_COL]): r["adla_okunur"]
               for r in raw_csv.check_headers(spark, list(files.values())).collect()}
    assert by_name["202307"] is True and by_name["202309"] is False and by_name["202310"] is True


def test_validation_report(spark, raw):
    d, files = raw
    rep = quality.validate(spark, sorted(files.values()), min_rows=MIN_ROWS)
    got = {raw_csv.month_of(r[schema.SOURCE_COL]): (r["durum"], list(r["nedenler"])) for r in rep.collect()}
    assert got["202302"] == ("TAM", [])
    assert got["202303"] == ("EKSIK/SORUNLU", ["eksik_gun"])
    assert got["202304"] == ("EKSIK/SORUNLU", ["kirik_gun"])
    assert got["202305"] == ("EKSIK/SORUNLU", ["kirik_gun"])
    assert got["202306"] == ("EKSIK/SORUNLU", ["kirik_gun"])        # the stray partial day
    assert got["202307"][1][0] == "sema"                             # profiled by name too
    assert got["202308"] == ("EKSIK/SORUNLU", ["null_yolcu"])
    assert got["202309"] == ("EKSIK/SORUNLU", ["sema"])                # not profiled: a column is missing
    assert got["202310"] == ("EKSIK/SORUNLU", ["sema"])                # extra column: profiled by name, complete
    assert quality.overall(rep).first()["hepsi_tam"] is False
    one = quality.validate(spark, [files["202302"]], min_rows=MIN_ROWS)
    assert quality.overall(one).first()["hepsi_tam"] is True
    by_month = {raw_csv.month_of(r[schema.SOURCE_COL]): r for r in rep.collect()}
    r4 = by_month["202304"]
    assert [(b["tarih"].day, b["saat"], b["satir"]) for b in r4["kirik_gunler"]] == [(10, 23, 46)]
    assert len(r4["tam_gunler"]) == 29 and r4["tam_gunler"] == sorted(r4["tam_gunler"])
    r6 = by_month["202306"]
    assert [(str(b["tarih"]), b["saat"], b["satir"]) for b in r6["kirik_gunler"]] == [("2023-07-01", 1, 1)]
    row = by_month["202308"]
    # blank town: spaces, bare empty, quoted empty -> 3 of 31*48 + 6 rows
    assert row["town_bos"] == 3
    assert row["yolcu_bos"] == 1


def test_ingest_gate_convert_and_rerun(spark, raw, tmpdir_path):
    d, files = raw
    clean_path = os.path.join(tmpdir_path, "clean")
    log_path = os.path.join(tmpdir_path, "log")
    res = ingest.ingest(spark, d, clean_path, log_path, min_rows=MIN_ROWS)
    assert res.accepted == [202302, 202306, 202307, 202308, 202310]  # 202307 swapped, 202310 extra: read by name
    rep = {r[schema.PERIOD_COL]: r for r in res.report.collect()}
    assert rep[202303]["durum"] == "reddedildi" and rep[202303]["tam_gun"] == 30 and rep[202303]["ay_gun"] == 31
    assert rep[202309]["durum"] == "reddedildi" and rep[202309]["neden"] == "sema"
    assert rep[202302]["csv_mb"] > 0 and rep[202302]["parquet_mb"] > 0

    clean = versioned.read(spark, clean_path)
    types = dict(clean.dtypes)
    assert types["transition_hour"] == "tinyint" and types["transport_type_id"] == "tinyint"
    assert types["number_of_passenger"] == "int" and types["transition_date"] == "date"
    months = sorted(r[0] for r in clean.select(schema.PERIOD_COL).distinct().collect())
    assert months == [202302, 202306, 202307, 202308, 202310]
    assert "ekstra" not in clean.columns and ingest.RAW_HOUR not in clean.columns
    jul = clean.where(F.col(schema.PERIOD_COL) == 202307)
    assert jul.count() == 31 * 48 and jul.agg(F.min("transition_date")).first()[0].isoformat() == "2023-07-01"
    assert jul.select("transition_hour").distinct().count() == 24
    # the stray day stays with its file's month
    assert clean.where((F.col("transition_date") == "2023-07-01") & (F.col(schema.PERIOD_COL) == 202306)).count() == 1
    towns = [r[0] for r in clean.where((F.col(schema.PERIOD_COL) == 202308)
                                       & (F.col("number_of_passenger").isNull() | (F.col("number_of_passenger") == 5)))
             .select("town").collect()]
    assert towns.count(None) == 3
    assert "KADIKOY" in towns and "\tTAB" in towns
    assert clean.where(F.col("line_name") == "M2").count() == clean.where(F.col("line_name").isNotNull()).count()

    n_before = clean.count()
    again = ingest.ingest(spark, d, clean_path, log_path, min_rows=MIN_ROWS)
    assert again.accepted == []
    states = {r[schema.PERIOD_COL]: r["durum"] for r in again.report.collect()}
    assert states[202302] == "atlandi" and states[202303] == "reddedildi"
    assert versioned.read(spark, clean_path).count() == n_before

    forced = ingest.ingest(spark, d, clean_path, log_path, months=["202303"], min_rows=MIN_ROWS, force=True)
    assert forced.accepted == [202303]
    assert forced.report.first()["neden"] == "force"
    assert versioned.read(spark, clean_path).count() == n_before + 30 * 48


def test_trips_year_scope_prunes_partitions(spark, raw, tmpdir_path):
    d, _ = raw
    clean_path = os.path.join(tmpdir_path, "clean")
    ingest.ingest(spark, d, clean_path, os.path.join(tmpdir_path, "log"), months=["202302"], min_rows=MIN_ROWS)
    t = model.trips(spark, clean_path, year=2023)
    plan = formatted_plan(t)
    assert "PartitionFilters" in plan and schema.PERIOD_COL in plan
    assert t.count() == 28 * 48
    assert set(t.columns) >= set(schema.CALENDAR_COLUMNS)
    assert model.trips(spark, clean_path, year=2022).count() == 0


def test_stream_ingest_picks_up_only_new_files(spark, tmpdir_path):
    from cityrhythm.streaming import ingest_stream
    raw_dir = os.path.join(tmpdir_path, "raw")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    clean_path, log_path = os.path.join(tmpdir_path, "clean"), os.path.join(tmpdir_path, "log")
    ck = os.path.join(tmpdir_path, "ck")
    ingest_stream.start(spark, raw_dir, clean_path, log_path, min_rows=MIN_ROWS, checkpoint=ck).awaitTermination()
    assert versioned.read(spark, clean_path).count() == 28 * 48
    write_csv(raw_dir, "202303", month_rows(2023, 3, skip_days=(2,)))     # rejected by the gate
    write_csv(raw_dir, "202304", month_rows(2023, 4))
    ingest_stream.start(spark, raw_dir, clean_path, log_path, min_rows=MIN_ROWS, checkpoint=ck).awaitTermination()
    months = sorted(r[0] for r in versioned.read(spark, clean_path).select(schema.PERIOD_COL).distinct().collect())
    assert months == [202302, 202304]
    log = {r[schema.PERIOD_COL]: r["durum"] for r in spark.read.parquet(log_path).collect()}
    assert log == {202302: "donusturuldu", 202303: "reddedildi", 202304: "donusturuldu"}
    # the rejected month is re-downloaded complete under the same name: it comes
    # again in the stream, and the batch ingest (which reads the log) has nothing left
    write_csv(raw_dir, "202303", month_rows(2023, 3))
    ingest_stream.start(spark, raw_dir, clean_path, log_path, min_rows=MIN_ROWS, checkpoint=ck).awaitTermination()
    assert versioned.read(spark, clean_path).where(F.col(schema.PERIOD_COL) == 202303).count() == 31 * 48
    assert ingest.ingest(spark, raw_dir, clean_path, log_path, min_rows=MIN_ROWS).accepted == []
    assert versioned.read(spark, clean_path).where(F.col(schema.PERIOD_COL) == 202303).count() == 31 * 48


def test_autopsy_on_raw_rows(spark, raw):
    """The autopsy operators run on cleaned raw rows (D4 with the mode id, D7, D9)."""
    from cityrhythm.operators import autopsy
    d, files = raw
    rows = ingest.clean(raw_csv.read_raw(spark, [files["202308"]]))
    nm = autopsy.null_map(rows).first()
    assert (nm["road_type"], nm["town_bos"], nm["hat_bos"], nm["istasyon_bos"]) == ("RAYLI", 3, 0, 0)
    mm = autopsy.mode_map(rows, with_id=True).first()
    assert (mm["transport_type_id"], mm["road_type"], mm["satir"]) == (2, "RAYLI", 31 * 48 + 6)
    bl = autopsy.blank_town_lines(rows).first()
    assert (bl["line_name"], bl["satir"]) == ("M2", 3)
    assert autopsy.passage_vs_passenger(rows).first()["farkli_satir"] == 31 * 48


def test_read_raw_rejects_a_header_that_changed_after_the_check(spark, raw):
    # Spark checks the header whenever data columns are read (the conversion reads all)
    d, files = raw
    with pytest.raises(Exception, match="(?i)header|CSV"):
        raw_csv.read_raw(spark, [files["202307"]]).select(*schema.RAW_COLUMNS).collect()


def test_modes_and_m7_lookup_end_to_end(spark, tmpdir_path):
    """DENİZ keeps its dotted İ; M7 rows get their district from the shipped
    station table when the station is known and stay NULL otherwise; town of
    other lines wins."""
    from cityrhythm.operators import autopsy, districts
    from cityrhythm.sources.lookup import builtin_lookup
    raw_dir = os.path.join(tmpdir_path, "raw_modes")
    base = ["2023-11-06", "23", "", "", "LINE", "Normal", "10", "10", "TAM", "Tam Kontur", "", "", ""]

    def row(mode_id, mode, town, line_name, station, pax):
        r = list(base)
        r[2], r[3], r[10], r[11], r[12], r[6], r[7] = mode_id, mode, town, line_name, station, pax, pax
        return r
    rows = [row("2", "RAYLI", "", "M7", "M7 FULYA", "100"),
            row("2", "RAYLI", " ", "M7", "UNKNOWN STOP", "50"),
            row("2", "RAYLI", "SISLI", "M2", "M7 FULYA", "30"),
            row("3", "DENİZ", "KADIKOY", "KADIKOY-KARAKOY", "KADIKOY ISKELE", "20"),
            row("1", "OTOYOL", "BAKIRKOY", "25G", "", "5")]
    write_csv(raw_dir, "202311", rows)
    clean_path = os.path.join(tmpdir_path, "clean_modes")
    res = ingest.ingest(spark, raw_dir, clean_path, os.path.join(tmpdir_path, "log_modes"), force=True)
    assert res.accepted == [202311]
    t = model.trips(spark, clean_path, year=2023)
    modes = {(r["transport_type_id"], r["road_type"]) for r in autopsy.mode_map(t, with_id=True).collect()}
    assert modes == {(1, "OTOYOL"), (2, "RAYLI"), (3, "DENİZ")}
    night = {r["ilce"]: (r["toplam_yolcu"], r["gece_yolcu"])
             for r in districts.night_index(t, builtin_lookup(spark), min_total=0).collect()}
    assert night == {"BESIKTAS": (100, 100), "SISLI": (30, 30)}       # unknown M7 stop has no district


def test_stream_backlog_in_bounded_batches(spark, tmpdir_path, monkeypatch):
    from cityrhythm.streaming import ingest_stream
    raw_dir = os.path.join(tmpdir_path, "raw_backlog")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    write_csv(raw_dir, "202304", month_rows(2023, 4))
    steps = []
    real = ingest_stream.ingest_files
    monkeypatch.setattr(ingest_stream, "ingest_files", lambda spark, files, *a: (steps.append(len(files)), real(spark, files, *a)))
    ingest_stream.start(spark, raw_dir, os.path.join(tmpdir_path, "clean_b"), os.path.join(tmpdir_path, "log_b"),
                        min_rows=MIN_ROWS, checkpoint=os.path.join(tmpdir_path, "ck_b"), files_per_batch=1).awaitTermination()
    assert steps == [1, 1]                                                         # one file a step
    months = sorted(r[0] for r in versioned.read(spark, os.path.join(tmpdir_path, "clean_b"))
                    .select(schema.PERIOD_COL).distinct().collect())
    assert months == [202302, 202304]


def test_gate_counts_hours_as_written(spark, tmpdir_path):
    """A complete month where one day also has an hour written "0" next to "00":
    that day has 25 distinct hour texts, so it is not full and the gate rejects
    the month; the stored hour would have been the same tinyint."""
    raw_dir = os.path.join(tmpdir_path, "raw_hours")
    rows = month_rows(2023, 2)
    extra = list(rows[0])
    extra[1] = "0"                                   # 2023-02-01, hour written without padding
    write_csv(raw_dir, "202302", rows + [extra])
    res = ingest.ingest(spark, raw_dir, os.path.join(tmpdir_path, "clean_h"), os.path.join(tmpdir_path, "log_h"),
                        min_rows=MIN_ROWS)
    r = res.report.first()
    assert res.accepted == [] and r["durum"] == "reddedildi" and r["tam_gun"] == 27


def test_header_only_file_is_reported(spark, tmpdir_path):
    raw_dir = os.path.join(tmpdir_path, "raw_empty")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    write_csv(raw_dir, "202303", [])                                  # header only
    res = ingest.ingest(spark, raw_dir, os.path.join(tmpdir_path, "clean_e"), os.path.join(tmpdir_path, "log_e"),
                        min_rows=MIN_ROWS)
    rep = {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in res.report.collect()}
    assert res.accepted == [202302] and rep[202303] == ("reddedildi", "bos dosya")
    only_empty = os.path.join(tmpdir_path, "raw_only_empty")
    write_csv(only_empty, "202304", [])
    res2 = ingest.ingest(spark, only_empty, os.path.join(tmpdir_path, "clean_e2"), os.path.join(tmpdir_path, "log_e2"),
                         min_rows=MIN_ROWS)
    assert res2.accepted == [] and res2.report.first()["neden"] == "bos dosya"


def test_validator_flags_header_only_file(spark, tmpdir_path):
    raw_dir = os.path.join(tmpdir_path, "raw_empty_v")
    f = write_csv(raw_dir, "202303", [])
    r = quality.validate(spark, [f], min_rows=MIN_ROWS).first()
    assert r["durum"] == "EKSIK/SORUNLU" and list(r["nedenler"]) == ["bos_dosya"]


def test_unparseable_value_rejects_only_its_file(spark, tmpdir_path):
    """One file has a non-numeric hour; it is rejected with a reason, the other
    month converts, and nothing of the bad file reaches the store."""
    raw_dir = os.path.join(tmpdir_path, "raw_bad")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    rows = month_rows(2023, 4)
    rows[5][1] = "1x"                                  # not an hour
    write_csv(raw_dir, "202304", rows)
    clean_path = os.path.join(tmpdir_path, "clean_bad")
    res = ingest.ingest(spark, raw_dir, clean_path, os.path.join(tmpdir_path, "log_bad"), min_rows=MIN_ROWS)
    rep = {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in res.report.collect()}
    assert res.accepted == [202302] and rep[202304] == ("reddedildi", "gecersiz deger")
    store = versioned.read(spark, clean_path)
    assert ingest.INVALID not in store.columns
    assert sorted(r[0] for r in store.select(schema.PERIOD_COL).distinct().collect()) == [202302]
    forced = ingest.ingest(spark, raw_dir, clean_path, os.path.join(tmpdir_path, "log_bad"), months=["202304"],
                           min_rows=MIN_ROWS, force=True)
    assert forced.accepted == []                       # force skips the completeness gate, not parsing


def test_malformed_line_rejects_only_its_file(spark, tmpdir_path):
    raw_dir = os.path.join(tmpdir_path, "raw_malformed")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    write_csv(raw_dir, "202304", month_rows(2023, 4), raw_lines=["2023-04-03,08,2,RAYLI"])   # too few fields
    clean_path = os.path.join(tmpdir_path, "clean_m")
    res = ingest.ingest(spark, raw_dir, clean_path, os.path.join(tmpdir_path, "log_m"), min_rows=MIN_ROWS)
    rep = {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in res.report.collect()}
    assert res.accepted == [202302] and rep[202304] == ("reddedildi", "gecersiz deger")
    assert raw_csv.CORRUPT not in versioned.read(spark, clean_path).columns


def test_stream_rejects_file_with_malformed_line(spark, tmpdir_path):
    from cityrhythm.streaming import ingest_stream
    raw_dir = os.path.join(tmpdir_path, "raw_sm")
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    write_csv(raw_dir, "202304", month_rows(2023, 4), raw_lines=["2023-04-03,08,2,RAYLI"])
    clean_path, log_path = os.path.join(tmpdir_path, "clean_sm"), os.path.join(tmpdir_path, "log_sm")
    ingest_stream.start(spark, raw_dir, clean_path, log_path, min_rows=MIN_ROWS,
                        checkpoint=os.path.join(tmpdir_path, "ck_sm")).awaitTermination()
    log = {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in spark.read.parquet(log_path).collect()}
    assert log == {202302: ("donusturuldu", None), 202304: ("reddedildi", "gecersiz deger")}
    assert raw_csv.CORRUPT not in versioned.read(spark, clean_path).columns


def test_validator_reports_malformed_lines(spark, tmpdir_path):
    raw_dir = os.path.join(tmpdir_path, "raw_vm")
    f = write_csv(raw_dir, "202302", month_rows(2023, 2), raw_lines=["2023-02-03,08,2,RAYLI"])
    r = quality.validate(spark, [f], min_rows=MIN_ROWS).first()
    assert r["bozuk_satir"] == 1 and "bozuk_satir" in list(r["nedenler"]) and r["durum"] == "EKSIK/SORUNLU"


def test_validation_checksum_is_order_independent(spark, tmpdir_path):
    rows = month_rows(2023, 2)
    a = write_csv(os.path.join(tmpdir_path, "ck_a"), "202302", rows)
    b = write_csv(os.path.join(tmpdir_path, "ck_b"), "202302", list(reversed(rows)))
    c = write_csv(os.path.join(tmpdir_path, "ck_c"), "202302", rows[:-1] + [rows[-1][:7] + ["99"] + rows[-1][8:]])
    sums = [quality.validate(spark, [f], min_rows=MIN_ROWS).first()["icerik_ozeti"] for f in (a, b, c)]
    assert sums[0] == sums[1] and sums[0] != sums[2]


def test_malformed_line_in_reordered_file_is_flagged(spark, tmpdir_path):
    from tests.csv_fixtures import RAW_COLUMNS
    swapped = list(RAW_COLUMNS)
    swapped[0], swapped[1] = swapped[1], swapped[0]
    rows = [[r[1], r[0]] + r[2:] for r in month_rows(2023, 2)]
    raw_dir = os.path.join(tmpdir_path, "raw_sw")
    f = write_csv(raw_dir, "202302", rows, header=swapped, raw_lines=["08,2023-02-03,2"])
    r = quality.validate(spark, [f], min_rows=MIN_ROWS).first()
    assert "bozuk_satir" in list(r["nedenler"])
    res = ingest.ingest(spark, raw_dir, os.path.join(tmpdir_path, "clean_sw"), os.path.join(tmpdir_path, "log_sw"),
                        min_rows=MIN_ROWS)
    assert res.accepted == [] and res.report.first()["neden"] == "gecersiz deger"


def _two_files(raw_dir, second_complete):
    """A complete month and another file of the same month (complete or with a day missing)."""
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    write_csv(raw_dir, "yedek_202302", month_rows(2023, 2, skip_days=() if second_complete else (9,), per_hour=3))


@pytest.mark.parametrize("second_complete", [False, True])
@pytest.mark.parametrize("force", [False, True])
def test_one_file_a_month_lands(spark, tmpdir_path, second_complete, force):
    raw_dir, store = os.path.join(tmpdir_path, "raw"), os.path.join(tmpdir_path, "store")
    _two_files(raw_dir, second_complete)
    res = ingest.ingest(spark, raw_dir, store, os.path.join(tmpdir_path, "log"), min_rows=MIN_ROWS, force=force)
    assert res.accepted == [202302]
    assert versioned.read(spark, store).count() == 28 * 48
    got = {raw_csv.file_name(r[schema.SOURCE_COL]): r["durum"] for r in res.report.collect()}
    assert got == {"hourly_transportation_202302.csv": ingest.CONVERTED, "hourly_transportation_yedek_202302.csv": ingest.SKIPPED}


def test_rejected_first_file_leaves_the_month_to_the_second(spark, tmpdir_path):
    raw_dir, store = os.path.join(tmpdir_path, "raw"), os.path.join(tmpdir_path, "store")
    write_csv(raw_dir, "202302", month_rows(2023, 2), raw_lines=["2023-02-03,xx,2,RAYLI,LINE X,Normal,5,5,TAM,Tam Kontur,FATIH,M2,S1"])
    write_csv(raw_dir, "yedek_202302", month_rows(2023, 2, per_hour=3))
    res = ingest.ingest(spark, raw_dir, store, os.path.join(tmpdir_path, "log"), min_rows=MIN_ROWS)
    assert res.accepted == [202302] and versioned.read(spark, store).count() == 28 * 72
    assert versioned.read(spark, store).where("transition_hour is null").count() == 0


@pytest.mark.parametrize("second_complete", [False, True])
def test_stream_lands_one_file_a_month_and_consults_the_log(spark, tmpdir_path, second_complete):
    from cityrhythm.streaming import ingest_stream
    raw_dir, store, log = (os.path.join(tmpdir_path, x) for x in ("raw", "store", "log"))
    _two_files(raw_dir, second_complete)

    def run():
        ingest_stream.start(spark, raw_dir, store, log, min_rows=MIN_ROWS, checkpoint=os.path.join(tmpdir_path, "cp")).awaitTermination()
    run()
    assert versioned.read(spark, store).count() == 28 * 48
    write_csv(raw_dir, "zzz_202302", month_rows(2023, 2, per_hour=4))          # a later file of a converted month
    run()
    assert versioned.read(spark, store).count() == 28 * 48
    last = {raw_csv.file_name(r[schema.SOURCE_COL]): r["durum"] for r in ingest.read_log(spark, log).collect()}
    assert last["hourly_transportation_zzz_202302.csv"] == ingest.SKIPPED


def test_stream_skips_months_converted_in_batch(spark, tmpdir_path):
    from cityrhythm.streaming import ingest_stream
    raw_dir, store, log = (os.path.join(tmpdir_path, x) for x in ("raw", "store", "log"))
    write_csv(raw_dir, "202302", month_rows(2023, 2))
    ingest.ingest(spark, raw_dir, store, log, min_rows=MIN_ROWS)
    write_csv(raw_dir, "202302", month_rows(2023, 2, per_hour=3))
    ingest_stream.start(spark, raw_dir, store, log, min_rows=MIN_ROWS, checkpoint=os.path.join(tmpdir_path, "cp")).awaitTermination()
    assert versioned.read(spark, store).count() == 28 * 48


def test_stream_rejects_foreign_headers_per_file(spark, tmpdir_path):
    from cityrhythm.streaming import ingest_stream
    raw_dir, store, log = (os.path.join(tmpdir_path, x) for x in ("raw", "store", "log"))
    build_months(raw_dir)
    ingest_stream.start(spark, raw_dir, store, log, min_rows=MIN_ROWS, checkpoint=os.path.join(tmpdir_path, "cp")).awaitTermination()
    batch = ingest.ingest(spark, raw_dir, os.path.join(tmpdir_path, "store2"), os.path.join(tmpdir_path, "log2"), min_rows=MIN_ROWS)
    decided = {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in ingest.read_log(spark, log).collect()}
    assert decided == {r[schema.PERIOD_COL]: (r["durum"], r["neden"]) for r in batch.report.collect()}
    assert decided[202309] == (ingest.REJECTED, "sema") and decided[202307][0] == ingest.CONVERTED
    a, b = (versioned.read(spark, os.path.join(tmpdir_path, x)) for x in ("store", "store2"))
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()
