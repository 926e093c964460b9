"""Oracle parity: every registered query against its DuckDB SQL on the
driver tables (sf0.001 here; the harness script runs any scale)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"

# FIXTURES.md §4 row counts at sf0.001
EXPECTED_ROWS = {
    "rows_E": 1, "hourly_profile": 48, "station_peak": 5, "hour_delta": 24, "moving_avg": 1094,
    "night_index": 0, "seasonal": 12, "card_share": 96, "dow_hour": 167, "anomaly": 1094,
    "station_share": 107, "top_towns": 69, "pulse": 91, "monthly_volume": 80, "hour_by_year": 168,
    "night_by_year": 35, "period_share": 28, "period_lift": 5, "day_completeness": 30, "null_map": 3,
    "month_coverage": 1, "month_gate": 1, "null_rates": 1, "dow_hour_pivot": 7, "anomaly_labels": 51,
    "series_annotations": 2, "night_map_index": 1, "night_top": 1, "station_matrix": 5,
    "pulse_filled": 96, "night_by_year_top": 21, "period_profile": 30, "evening_spine": 20,
    "index_scale": 1, "map_enrich": 4, "coverage_pairs": 1, "day_profile": 30, "mode_map": 3,
    "town_count": 1, "town_top": 3, "line_stations": 4, "blank_town_lines": 2, "passage_vs_passenger": 1,
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, con)
    assert r["status"] == "ok", r
    assert r["exact"], r
    assert "types" not in r, r
    if name in EXPECTED_ROWS:
        assert r["spark_rows"] == EXPECTED_ROWS[name]


def test_every_query_has_a_builder_and_sql_keys_subset():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(EXPECTED_ROWS) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["gun_tipi", "saat", "ortalama_yolcu"]
    assert df.count() == 48


def _fixture_rows() -> dict[str, list[int]]:
    """FIXTURES.md §4: query -> rows at sf0.001 / 0.01 / 0.1."""
    import os
    import re
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
    text = open(path, encoding="utf-8").read().split("## 4.")[1].split("## 5.")[0]
    out = {}
    for line in text.splitlines():
        m = re.match(r"\| (\w+) \|.*\| \**([\d ]+)\** / ([\d ]+) / ([\d ]+) \|$", line)
        if m:
            out[m.group(1)] = [int(x.replace(" ", "")) for x in m.groups()[1:]]
    return out


FIXTURE_ROWS = _fixture_rows()


def test_fixture_table_parsed():
    assert len(FIXTURE_ROWS) == 43


@pytest.mark.parametrize("name", sorted(FIXTURE_ROWS))
def test_row_counts_at_sf001_match_fixtures(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.01").count() == FIXTURE_ROWS[name][1]


def test_results_do_not_depend_on_session_settings(spark, con):
    """Exact equality holds with other shuffle partition counts, AQE off and
    ANSI off (the driver's session need not use this engine's defaults)."""
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.enabled": "false",
            "spark.sql.ansi.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, sql in sorted(entry.oracle_sql().items()):
            r = compare(spark, name, entry.queries()[name], sql, SF, con)
            assert r["status"] == "ok" and r["exact"] and "types" not in r, r
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
