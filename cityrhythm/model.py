"""The trips view and the test facades.

``trips`` is the base relation of every analytical operator: the clean rows
plus calendar columns (year, month, ISO weekday, day type). It is read from the
clean Parquet store, where a year scope becomes a partition filter.

The two facades present the driver's TPC-H-like tables in the same shape so
that every operator can be checked against an independent SQL engine:

* facade E (hourly, one month) from ``events``
* facade O (daily, multi-year) from ``orders``

Both attach a customer dimension ``customer -> nation -> region``. The
dimension is joined by Catalyst's size-checked strategy: broadcast while its
statistics stay under the broadcast threshold, otherwise a shuffle join whose
hot keys AQE splits (``skewJoin``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm import schema
from cityrhythm.functions.calendar import day_type, iso_weekday
from cityrhythm.sources import tables, versioned

# --- Fixed values of the facades (see FIXTURES.md §3) -------------------------
FACADE_M7_SEGMENT = "MACHINERY"       # plays line M7: its district is NULL
FACADE_ROAD_TYPES = ("OTOYOL", "RAYLI", "DENIZ")   # by key % 3
FACADE_UNMATCHED_NATION = 3           # nation left out of the facade lookup
FACADE_E_CARD_KINDS = ("view", "click", "signup", "purchase")
FACADE_O_STUDENT_CARD = "1-URGENT"


def with_calendar(df: DataFrame, date_col: str = "transition_date") -> DataFrame:
    """B2: add yil, ay, haftanin_gunu (1=Mon) and gun_tipi from the date."""
    d = F.col(date_col)
    return df.select(
        "*",
        F.year(d).cast("int").alias("yil"),
        F.month(d).cast("int").alias("ay"),
        iso_weekday(d).alias("haftanin_gunu"),
        day_type(d).alias("gun_tipi"),
    )


def trips(spark: SparkSession, clean_path: str, year: int | None = None) -> DataFrame:
    """B1: trips over the clean store's published months; ``year`` prunes partitions by source month."""
    df = versioned.read(spark, clean_path)
    if year is not None:
        df = df.where(F.col(schema.PERIOD_COL).between(year * 100 + 1, year * 100 + 12))
    return with_calendar(df)


def register_trips_view(spark: SparkSession, clean_path: str, year: int | None = None,
                        name: str = "yolculuk") -> DataFrame:
    """Register the trips relation (B1, B2) as a temporary view for SQL users:
    ``spark.sql("SELECT gun_tipi, ... FROM yolculuk ...")``. The year scope is
    a partition filter; Spark SQL dialect differences from other engines
    (e.g. ``FILTER (WHERE ...)``, no ``QUALIFY``) still apply."""
    df = trips(spark, clean_path, year)
    df.createOrReplaceTempView(name)
    return df


def _road_type(key: Column) -> Column:
    r = key % 3
    return (F.when(r == 0, F.lit(FACADE_ROAD_TYPES[0]))
            .when(r == 1, F.lit(FACADE_ROAD_TYPES[1]))
            .otherwise(F.lit(FACADE_ROAD_TYPES[2])))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (name, region name) as a DataFrame."""
    return (tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
            .join(tables.read(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name"))


def _with_customer(facts: DataFrame, key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach line (segment), station (nation) and town (region; NULL for the
    M7 stand-in) to fact rows.

    The fact rows join ``customer`` first (both base relations, so the
    broadcast decision compares real file statistics): customer is broadcast
    only while it is under the threshold, beyond that it is a shuffle join on
    the key whose hot keys AQE splits. nation and region are joined the same way.
    """
    cust = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = (facts.join(cust, F.col(key) == F.col("c_custkey"))
         .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")))
    seg = F.col("c_mktsegment")
    return j.select(*facts.columns,
                    seg.alias("line_name"),
                    F.col("n_name").alias("station_poi_desc_cd"),
                    F.when(seg == F.lit(FACADE_M7_SEGMENT), F.lit(None).cast("string"))
                     .otherwise(F.col("r_name")).alias("town"))


def _year_range(col: str, year: int | None) -> Column | None:
    if year is None:
        return None
    lo = dt.datetime(year, 1, 1)
    hi = dt.datetime(year + 1, 1, 1)
    # a plain range on the source timestamp reaches the Parquet scan as PushedFilters
    return (F.col(col) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(col) < F.lit(hi).cast("timestamp_ntz"))


def facade_events(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Facade E: one trip row per event (hourly, one month)."""
    ev = tables.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rng = _year_range("ts", year)
    if rng is not None:
        ev = ev.where(rng)
    pax = F.round(F.col("value") * F.lit(100.0)).cast("long")
    df = (_with_customer(ev, "user_id", spark, sf_dir)
          .select(
              F.col("ts").cast("date").alias("transition_date"),
              F.hour("ts").cast("tinyint").alias("transition_hour"),
              _road_type(F.col("user_id")).alias("road_type"),
              F.col("event_type").alias("product_kind"),
              "line_name", "station_poi_desc_cd", "town",
              pax.alias("number_of_passenger"),
              (pax + F.when(F.col("event_id") % 12 == 0, F.lit(1)).otherwise(F.lit(0))).alias("number_of_passage"),
          ))
    return with_calendar(df)


def facade_orders(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Facade O: one trip row per order (daily, multi-year; hour = key % 24)."""
    od = tables.read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    rng = _year_range("o_orderdate", year)
    if rng is not None:
        od = od.where(rng)
    pax = F.round(F.col("o_totalprice")).cast("long")
    df = (_with_customer(od, "o_custkey", spark, sf_dir)
          .select(
              F.col("o_orderdate").cast("date").alias("transition_date"),
              (F.col("o_orderkey") % 24).cast("tinyint").alias("transition_hour"),
              _road_type(F.col("o_custkey")).alias("road_type"),
              F.col("o_orderpriority").alias("product_kind"),
              "line_name", "station_poi_desc_cd", "town",
              pax.alias("number_of_passenger"),
              (pax + F.when(F.col("o_orderkey") % 12 == 0, F.lit(1)).otherwise(F.lit(0))).alias("number_of_passage"),
          ))
    return with_calendar(df)


def facade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station -> district lookup of the facades (plays the M7 lookup).

    Derived from nation/region; one nation is left out so that some stations
    stay unmatched, as stations missing from the real lookup would.
    """
    return (tables.read(spark, sf_dir, "nation")
            .where(F.col("n_nationkey") != FACADE_UNMATCHED_NATION)
            .join(tables.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("istasyon"), F.col("r_name").alias("ilce")))
