"""Structural plan properties of every registered query (what PLANS.md shows):
one scan of the fact table, no nested-loop or cartesian join, and the fact
scan reads only columns the facade uses."""

from __future__ import annotations

import pytest

from cityrhythm.plans.inspect import summary
from cityrhythm.plans.registry import REGISTRY

SF = "/root/testdata/sf0.01"
FACTS = {"events", "orders"}


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if not n.startswith("station_cluster")))
def test_plan_shape(spark, name):
    df = REGISTRY[name].build(spark, SF)
    df.collect()                                   # after the action the summary is AQE's final plan
    s = summary(df)
    facts = [t for t, _, _ in s["scans"] if t in FACTS]
    assert len(facts) == 1, s
    assert not any("NestedLoop" in j or "Cartesian" in j for j in s["joins"]), s
    for table, cols, _ in s["scans"]:
        if table == "events":
            assert "props" not in cols, s           # column pruning reaches the scan
