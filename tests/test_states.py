"""Mergeable day states (A5, D2, D3), footers (A4, D1), period days (B5), kept daily totals and moments."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cityrhythm import dims, model, schema
from cityrhythm.operators import autopsy, daily, enrich, ingest
from cityrhythm.plans import registry, rollup
from cityrhythm.plans.inspect import formatted_plan, summary
from cityrhythm.sources import versioned
from tests.conftest import make_trips
from tests.csv_fixtures import MIN_ROWS, month_rows, write_csv

SF = "/root/testdata/sf0.001"


def _hours(rng: random.Random) -> list[tuple]:
    texts = [f"{h:02d}" for h in range(24)] + ["0", "7", "24", "x", "", None]
    days = [dt.date(2023, 2, d) for d in (1, 2, 3)] + [None]
    return [(f"f{rng.randrange(2)}", rng.choice(days), rng.choice(texts), rng.random() < .01, rng.randrange(9)) for _ in range(400)]


def test_day_states_merge_in_any_split(spark, tmp_path):
    rows = _hours(random.Random(1))
    df = spark.createDataFrame(rows, "dosya string, transition_date date, transition_hour string, f boolean, number_of_passenger int")
    want = defaultdict(lambda: [set(), 0, False, 0])
    for f, d, h, bad, p in rows:
        w = want[f, d]
        w[0] |= {h} - {None}
        w[1] += 1
        w[2] |= bad
        w[3] += p
    whole = autopsy.day_state(df, ["dosya"], "f", passengers=True)
    parts = [df.where(f"hash(transition_hour, number_of_passenger) % 3 {cond}") for cond in ("= 0", "> 0", "< 0")] + [df.where("false")]
    stored = str(tmp_path / "states")
    for p in parts:         # each part's states are stored on their own
        autopsy.day_state(p, ["dosya"], "f", passengers=True).write.mode("append").parquet(stored)
    merged = autopsy.merge_states(spark.read.parquet(stored), ["dosya"])
    cols = ["dosya", "transition_date", autopsy.HOUR_BITS, autopsy.HOUR_OTHERS, autopsy.HOUR_NULL, "satir", "f", "yolcu"]
    assert sorted(map(repr, merged.select(cols).collect())) == sorted(map(repr, whole.select(cols).collect()))
    got = {(r.dosya, r.transition_date): [r.saat, r.satir, r.f] for r in autopsy.completeness_of_states(merged, 10, ["dosya"], "f").collect()}
    assert got == {k: [len(v[0]), v[1], v[2]] for k, v in want.items()}
    pairs = {r.dosya: r.dolu_kombinasyon for r in autopsy.coverage_of_states(merged, ["dosya"]).collect()}
    assert pairs == {f: len({(d, h) for g, d, h, _, _ in rows if g == f}) for f in ("f0", "f1")}


def test_a_month_in_two_deliveries_is_judged_from_states(spark, tmp_path):
    rows = [(dt.date(2023, 2, d), h) for d in range(1, 29) for h in range(24) for _ in range(2)]
    half = [r for r in rows if r[1] < 12 or r[0].day > 20]
    rest = [r for r in rows if not (r[1] < 12 or r[0].day > 20)]
    for part in (half, rest):
        (autopsy.day_state(spark.createDataFrame(part, "transition_date date, transition_hour tinyint"))
         .write.mode("append").parquet(str(tmp_path / "s")))
        states = autopsy.merge_states(spark.read.parquet(str(tmp_path / "s")))
        gate = autopsy.gate_of_states(states, 48).first()
    assert gate.kabul and gate.tam_gun == 28
    assert not autopsy.month_gate(spark.createDataFrame(half, "transition_date date, transition_hour tinyint"), 48).first().kabul


def test_day_states_need_one_shuffle(spark):
    for build in (autopsy.day_completeness, autopsy.day_profile):
        df = build(registry.E(spark, SF))
        df.collect()
        assert summary(df)["shuffles"] == 1, summary(df)


def test_coverage_from_footers(spark, tmp_path):
    raw, store, log = (str(tmp_path / x) for x in ("raw", "store", "log"))
    for m in (2, 3):
        write_csv(raw, f"20230{m}", month_rows(2023, m))
    ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    cover = autopsy.store_coverage(spark, store)
    assert "PushedAggregation: [COUNT(*), MIN(transition_date), MAX(transition_date)]" in formatted_plan(cover)
    rows = model.trips(spark, store)
    want = autopsy.month_coverage(rows, [schema.PERIOD_COL]).select(schema.PERIOD_COL, "satir", "ilk_gun", "son_gun").collect()
    assert sorted(map(tuple, cover.collect())) == sorted(map(tuple, want))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def _periods(n: int) -> list[dims.Period]:
    out = []
    for i in range(n):
        y = 1500 + i
        out.append(dims.Period(y, f"{y}-03-10", f"{y}-04-05", f"{y}-02-01", f"{y}-05-31", (f"{y}-04-06", f"{y}-04-08")))
    return out


@pytest.mark.parametrize("as_list", [True, False])
def test_overlapping_periods_tag_a_day_once(spark, as_list):
    periods = [dims.Period(2023, "2023-03-10", "2023-03-12", "2023-03-01", "2023-03-20", ("2023-03-13", "2023-03-14")),
               dims.Period(2023, "2023-03-13", "2023-03-15", "2023-03-12", "2023-03-31", ("2023-03-30", "2023-04-02")),
               dims.Period(2022, "2022-12-30", "2023-01-02", "2022-12-28", "2023-01-05", ("2022-12-29", "2022-12-29"))]
    start = dt.date(2022, 12, 25)
    days = [start + dt.timedelta(days=i) for i in range(120)]
    want = {}
    for d in days:
        of = [p for p in periods if p.year == d.year and p.window_start <= str(d) <= p.window_end and not p.excluded[0] <= str(d) <= p.excluded[1]]
        if of:
            want[d] = "ramazan" if any(p.year == d.year and p.start <= str(d) <= p.end for p in periods) else "normal"
    t = make_trips(spark, [{"transition_date": d} for d in days])
    given = periods
    if not as_list:
        given = spark.createDataFrame([(p.year, *map(dt.date.fromisoformat, (p.start, p.end, p.window_start, p.window_end, *p.excluded))) for p in periods],
                                      "yil int, baslangic date, bitis date, pencere_bas date, pencere_son date, haric_bas date, haric_son date")
    got = enrich.tag_periods(t, given).select("transition_date", "donem").collect()
    assert sorted(map(tuple, got)) == sorted(want.items())


def test_many_periods_keep_the_plan_small_and_prune(spark, tmp_path):
    path = str(tmp_path / "r")
    rollup.write_rollup(rollup.hourly_rollup(registry.O(spark, SF)), path)
    plans = {}
    for n in (20, 500):
        df = enrich.tag_periods(rollup.read_rollup(spark, path), _periods(n))
        plans[n] = formatted_plan(df)
        scan = next(x for x in plans[n].split("\n") if "PartitionFilters" in x)
        assert "yil" in scan and "ay" in scan
        pushed = next(x for x in plans[n].split("\n") if "PushedFilters" in x)
        assert "GreaterThanOrEqual(transition_date" in pushed and "LessThanOrEqual(transition_date" in pushed
    assert abs(len(plans[20].split("\n")) - len(plans[500].split("\n"))) <= 2 and plans[500].count("AND") <= plans[20].count("AND") + 2


def test_scan_ranges_hold_all_windows():
    rng = random.Random(4)
    for n in (1, 2, 16, 17, 200):
        windows = [(a, a + dt.timedelta(days=rng.randrange(90))) for a in (dt.date(1900, 1, 1) + dt.timedelta(days=rng.randrange(40_000)) for _ in range(n))]
        got = enrich.scan_ranges(windows)
        assert len(got) <= 16 and got == sorted(got) and all(x[1] < y[0] for x, y in zip(got, got[1:]))
        assert all(any(a <= w[0] and w[1] <= b for a, b in got) for w in windows)
    apart = [(dt.date(1996 + i, 2, 1), dt.date(1996 + i, 5, 31)) for i in range(2)]
    assert enrich.scan_ranges(apart) == apart


def test_kept_daily_totals_and_moments(spark, tmp_path, monkeypatch):
    raw, store, log = (str(tmp_path / x) for x in ("raw", "store", "log"))
    rng = random.Random(3)

    def add(y, m):
        rows = month_rows(y, m)
        for r in rows:
            r[7] = str(rng.randrange(1000))
        write_csv(raw, f"{y}{m:02d}", rows)
        ingest.ingest(spark, raw, store, log, min_rows=MIN_ROWS)
    add(2023, 2)
    add(2023, 3)
    assert rollup.update_daily(spark, store) == [202302, 202303] and rollup.update_daily(spark, store) == []

    def moments(months):
        days = daily.daily_totals(rollup.kept_daily(spark, store).where(F.col(schema.PERIOD_COL).isin(months)), ["haftanin_gunu"])
        return daily.weekday_moments(days)
    old = spark.createDataFrame(moments([202302, 202303]).collect(), "haftanin_gunu int, n long, ort double, m2 double")
    add(2023, 4)
    read = []
    real = versioned.read
    monkeypatch.setattr(rollup.versioned, "read", lambda *a, **k: (read.append(k.get("months")), real(*a, **k))[1])
    assert rollup.update_daily(spark, store) == [202304]
    assert read and all(x == [202304] for x in read)            # adding a month reads that month only
    monkeypatch.setattr(rollup.versioned, "read", real)
    kept = rollup.kept_daily(spark, store)
    trips = model.trips(spark, store)
    assert sorted(map(tuple, daily.moving_avg(kept).collect())) == sorted(map(tuple, daily.moving_avg(trips).collect()))
    z = {r.transition_date: r.z_ham for r in daily.anomaly(trips).collect()}
    assert {r.transition_date: pytest.approx(r.z_ham, abs=1e-12) for r in daily.anomaly(kept).collect()} == z
    merged = daily.merge_moments(old.unionByName(moments([202304])))
    days = daily.daily_totals(kept, ["haftanin_gunu"])
    got = {r.transition_date: r for r in daily.anomaly_of_moments(days, merged, z_limit=1.5).collect()}
    for r in daily.anomaly(trips, z_limit=1.5).collect():
        assert got[r.transition_date].z_ham == pytest.approx(r.z_ham, abs=1e-9, rel=1e-12) and got[r.transition_date].anomali == r.anomali


def test_no_job_while_a_query_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in ("hourly_profile", "night_by_year", "top_towns", "period_lift", "day_completeness", "null_map"):
        spark.sparkContext.setJobGroup(f"build-{name}", "")
        try:
            registry.REGISTRY[name].build(spark, SF)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert list(tracker.getJobIdsForGroup(f"build-{name}")) == [], name
