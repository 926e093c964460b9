from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cityrhythm.session import build_session
    s = build_session("local[4]", app="cityrhythm-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    # a fresh folder per test; never cleared by the tests themselves
    return tempfile.mkdtemp(prefix="cityrhythm-test-")


TRIP_SCHEMA = T.StructType([
    T.StructField("transition_date", T.DateType()),
    T.StructField("transition_hour", T.ByteType()),
    T.StructField("road_type", T.StringType()),
    T.StructField("product_kind", T.StringType()),
    T.StructField("line_name", T.StringType()),
    T.StructField("station_poi_desc_cd", T.StringType()),
    T.StructField("town", T.StringType()),
    T.StructField("number_of_passenger", T.LongType()),
    T.StructField("number_of_passage", T.LongType()),
])


def make_trips(spark: SparkSession, rows: list[dict]):
    """Trips from dicts (missing keys -> defaults), calendar columns derived."""
    from cityrhythm.model import with_calendar
    defaults = dict(road_type="RAYLI", product_kind="TAM", line_name="M2", station_poi_desc_cd="S1",
                    town="FATIH", number_of_passenger=1, number_of_passage=None, transition_hour=8)
    out = []
    for r in rows:
        d = {**defaults, **r}
        if isinstance(d["transition_date"], str):
            d["transition_date"] = dt.date.fromisoformat(d["transition_date"])
        if d["number_of_passage"] is None:
            d["number_of_passage"] = d["number_of_passenger"]
        out.append(tuple(d[f.name] for f in TRIP_SCHEMA.fields))
    return with_calendar(spark.createDataFrame(out, TRIP_SCHEMA))
