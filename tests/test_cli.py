"""The command line maps each command onto its job (run in-process)."""

from __future__ import annotations

import os

from cityrhythm.__main__ import main
from cityrhythm.plans import registry
from cityrhythm.sources import versioned
from tests.csv_fixtures import MIN_ROWS, month_rows, write_csv


def test_cli_commands(spark, tmpdir_path, capsys):
    raw = os.path.join(tmpdir_path, "raw")
    write_csv(raw, "202212", month_rows(2022, 12))
    good = write_csv(raw, "202302", month_rows(2023, 2))
    bad = write_csv(raw, "202303", month_rows(2023, 3, skip_days=(9,)))
    assert main(["validate", good, "--esik", str(MIN_ROWS)]) == 0
    assert main(["validate", good, bad, "--esik", str(MIN_ROWS)]) == 1
    assert main(["autopsy", good]) == 0
    shown = capsys.readouterr().out
    assert "== blank map by mode" in shown and "RAYLI" in shown
    store = os.path.join(tmpdir_path, "store")
    assert main(["ingest", "--raw", raw, "--store", store, "--esik", str(MIN_ROWS)]) == 0
    assert sorted(r[0] for r in versioned.read(spark, store).select("yilay").distinct().collect()) == [202212, 202302]
    assert main(["ingest", "202303", "--raw", raw, "--store", store, "--force"]) == 0
    assert sorted(r[0] for r in versioned.read(spark, store).select("yilay").distinct().collect()) == \
        [202212, 202302, 202303]
    out = os.path.join(tmpdir_path, "out")
    assert main(["year", "2023", "--store", store, "--out", out]) == 0
    assert main(["night-map", "2023", "--store", store, "--out", out + "_map",
                 "--boundaries", registry.BOUNDARIES]) == 0
    assert main(["compare", "--store", store, "--out", out + "_cmp"]) == 0
    assert main(["special", "--store", store, "--out", out + "_special", "--year", "2023", "--no-rollup"]) == 0
    assert main(["pulse-map", "2023", "--store", store, "--out", out + "_pulse",
                 "--boundaries", registry.BOUNDARIES]) == 0
    printed = capsys.readouterr().out
    for table in ("saatlik_profil:", "harita:", "aylik_hacim:", "kart_tipi:", "kareler:"):
        assert table in printed
    assert spark.read.parquet(os.path.join(out, "saatlik_profil")).count() == 48
