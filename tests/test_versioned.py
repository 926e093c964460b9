"""Published versions of a month table (A9), re-delivered files (A10), file listings."""

from __future__ import annotations

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from cityrhythm import model, schema
from cityrhythm.operators import ingest
from cityrhythm.plans import rollup
from cityrhythm.plans.inspect import formatted_plan
from cityrhythm.sources import raw_csv, versioned
from cityrhythm.streaming import ingest_stream
from tests.csv_fixtures import MIN_ROWS, month_rows, write_csv


@pytest.fixture()
def places(tmp_path):
    return tuple(str(tmp_path / x) for x in ("raw", "store", "log", "cp"))


def decisions(spark, log):
    return [(r[schema.PERIOD_COL], raw_csv.file_name(r[schema.SOURCE_COL]).split("_")[-1][:6], r["durum"], r["neden"])
            for r in ingest.read_log(spark, log).orderBy("zaman", schema.SOURCE_COL).collect()]


def test_a_killed_run_leaves_months_as_they_were(spark, places, monkeypatch):
    raw, store, log, _ = places
    write_csv(raw, "202302", month_rows(2023, 2))
    ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    write_csv(raw, "202303", month_rows(2023, 3))
    write_csv(raw, "202304", month_rows(2023, 4))
    real = versioned.publish

    def killed(*args, **more):
        raise KeyboardInterrupt
    # between the copy and the manifest: nothing is seen
    monkeypatch.setattr(versioned, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    assert model.trips(spark, store).select("ay").distinct().collect() == [(2,)]
    assert {d[0] for d in decisions(spark, log)} == {202302}
    # after one of two manifests, before the log: that month is whole, the other as it was

    def once(*args, **more):
        monkeypatch.setattr(versioned, "publish", killed)
        return real(*args, **more)
    monkeypatch.setattr(versioned, "publish", once)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    rows = {r[schema.PERIOD_COL]: r["count"] for r in model.trips(spark, store).groupBy(schema.PERIOD_COL).count().collect()}
    assert rows == {202302: 28 * 48, 202303: 31 * 48} and {d[0] for d in decisions(spark, log)} == {202302}
    # the next run enters what was not logged, and takes only the rest
    monkeypatch.setattr(versioned, "publish", real)
    assert ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS).accepted == [202304]
    logged = [d for d in decisions(spark, log) if d[2] == ingest.CONVERTED]
    assert sorted(d[0] for d in logged) == [202302, 202303, 202304]
    march = ingest.read_log(spark, log).where("yilay = 202303 and durum = 'donusturuldu'").first()
    assert march["tam_gun"] == march["ay_gun"] == 31 and march["csv_mb"] > 0 and march["parquet_mb"] > 0
    assert versioned.read(spark, store).count() == (28 + 31 + 30) * 48
    # the data of the two killed runs is seen by nobody and can go
    assert versioned.vacuum(spark, store) == []
    assert len(versioned.vacuum(spark, store, dt.timedelta(seconds=-1))) == 1 + 0 and versioned.read(spark, store).count() == (28 + 31 + 30) * 48


def test_parallel_runs_land_one_file(spark, tmp_path, monkeypatch):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    for k in (2, 3):
        write_csv(str(tmp_path / f"raw{k}"), "202302", month_rows(2023, 2, per_hour=k))
    real, both = versioned.publish, threading.Barrier(2)

    def together(*args, **more):
        both.wait(120)      # both have judged and copied; neither has seen the other
        return real(*args, **more)
    monkeypatch.setattr(versioned, "publish", together)
    got = {}

    def run(k):
        got[k] = ingest.ingest(spark, str(tmp_path / f"raw{k}"), store, log, min_rows=MIN_ROWS)
    threads = [threading.Thread(target=run, args=(k,)) for k in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert sorted(len(r.accepted) for r in got.values()) == [0, 1]
    winner = next(k for k, r in got.items() if r.accepted)
    assert versioned.read(spark, store).count() == 28 * 24 * winner
    assert sorted(d[2] for d in decisions(spark, log)) == sorted([ingest.CONVERTED, ingest.SKIPPED])


@pytest.mark.parametrize("how", ["link", "rename"])
def test_a_file_is_created_once(spark, tmp_path, monkeypatch, how):
    if how == "rename":     # the way of other stores
        monkeypatch.setattr(versioned, "_link", lambda hidden, target: versioned._rename(spark, hidden.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hidden, target))
    path = str(tmp_path / "a" / "00000001.json")
    assert versioned.create_if_absent(spark, path, "one\n") and not versioned.create_if_absent(spark, path, "two\n")
    assert open(path).read() == "one\n" and [f for f in os.listdir(tmp_path / "a") if not f.endswith(".crc")] == ["00000001.json"]


def test_versions_replace_a_month_and_readers_keep_theirs(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(202301, 1), (202302, 1)], "yilay int, x int")
    first = versioned.write(rows, table)
    for m in (202301, 202302):
        assert versioned.publish(spark, table, m, first, 0, versioned.sizes(spark, table, first)[m])
    before = versioned.read(spark, table, rows.schema)
    second = versioned.write(rows.where("yilay = 202301").withColumn("x", F.lit(2)), table)
    size = versioned.sizes(spark, table, second)
    assert not versioned.publish(spark, table, 202301, second, 0, size[202301])        # the month has moved on
    assert versioned.publish(spark, table, 202301, second, 1, size[202301])
    assert sorted(map(tuple, before.select("yilay", "x").collect())) == [(202301, 1), (202302, 1)]
    assert sorted(map(tuple, versioned.read(spark, table, rows.schema).select("yilay", "x").collect())) == [(202301, 2), (202302, 1)]
    assert versioned.vacuum(spark, table, dt.timedelta(seconds=-1)) == []              # February still reads the first
    assert versioned.read(spark, table, rows.schema, months=[202305]).count() == 0


def test_a_broken_log_or_manifest_is_an_error(spark, places):
    raw, store, log, _ = places
    write_csv(raw, "202302", month_rows(2023, 2))
    assert ingest.converted_months(spark, log) == set()
    os.makedirs(log)
    with open(os.path.join(log, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    os.makedirs(os.path.join(store, "_manifest", "202302"))
    with open(os.path.join(store, "_manifest", "202302", "00000001.json"), "w") as f:
        f.write("{")
    with pytest.raises(Exception):
        versioned.current(spark, store)


def test_stream_takes_a_file_that_comes_again(spark, places):
    raw, store, log, cp = places

    def run():
        ingest_stream.start(spark, raw, store, log, min_rows=MIN_ROWS, checkpoint=cp).awaitTermination()
    write_csv(raw, "202302", month_rows(2023, 2, skip_days=(3,)))
    write_csv(raw, "202303", [])                                            # a header alone
    write_csv(raw, "202304", month_rows(2023, 4))
    run()
    assert sorted(decisions(spark, log)) == [(202302, "202302", ingest.REJECTED, "eksik/bozuk"), (202303, "202303", ingest.REJECTED, "bos dosya"),
                                             (202304, "202304", ingest.CONVERTED, None)]
    run()                                                                   # nothing new, nothing done
    assert len(decisions(spark, log)) == 3
    write_csv(raw, "202302", month_rows(2023, 2))                           # downloaded again, now whole
    old = write_csv(raw, "202305", month_rows(2023, 5))                     # late, and with an old time
    os.utime(old, (1_000_000_000, 1_000_000_000))
    run()
    assert sorted(decisions(spark, log)[3:]) == [(202302, "202302", ingest.CONVERTED, None), (202305, "202305", ingest.CONVERTED, None)]
    assert sorted(r[0] for r in versioned.read(spark, store).select(schema.PERIOD_COL).distinct().collect()) == [202302, 202304, 202305]


def test_listings_open_no_file(spark, places):
    raw, store, log, _ = places
    write_csv(raw, "202302", month_rows(2023, 2))
    ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    version = versioned.current(spark, store)[202302]
    files = versioned.listing(spark, f"{versioned.data_path(store)}/{versioned.VERSION_COL}={version.surum}")
    plan = formatted_plan(files.groupBy(schema.PERIOD_COL).agg(F.sum("length")))
    assert "binaryFile" in plan.replace("BinaryFile", "binaryFile") and "ReadSchema: struct<length:bigint>" in plan
    plain = str(places[3])
    versioned.read(spark, store).write.partitionBy(schema.PERIOD_COL).parquet(plain)
    for table, plain_table in ((store, False), (plain, True)):
        assert set(rollup.month_signatures(spark, table)) == {202302}
        assert ingest.parquet_sizes(spark, table)[202302] == pytest.approx(
            sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(table if plain_table else os.path.join(table, "_data"))
                for f in names if f.endswith(".parquet")) / 1e6)
        # overwritten data files are noticed without being read
        for d, _, names in os.walk(table):
            for f in names:
                if f.endswith(".parquet"):
                    with open(os.path.join(d, f), "r+b") as out:
                        out.write(b"XXXX")
        assert set(rollup.month_signatures(spark, table)) == {202302} and ingest.parquet_sizes(spark, table)[202302] > 0


def test_headers_take_one_job(spark, tmp_path):
    raw = str(tmp_path / "raw")
    for m in range(1, 10):
        write_csv(raw, f"20230{m}", [], header=None if m % 2 else list(reversed(schema.RAW_COLUMNS)))
    write_csv(raw, "202310", [], header=['"a,b"', "", "x", "X", "é"])
    open(os.path.join(raw, "hourly_transportation_202311.csv"), "w").close()
    files = raw_csv.list_month_files(spark, raw)
    spark.sparkContext.setJobGroup("headers", "")
    try:
        got = raw_csv.headers(spark, files)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 2     # AQE runs the shuffle's map stage as a job
    assert got == {f: raw_csv.header_of(spark, f) for f in files}
    assert [len(got[f]) for f in files] == [13] * 9 + [5, 0]
