"""The hourly roll-up: one row per (date, hour, mode, card kind, line, station,
town) with summed passengers / passages and row counts.

All analytical operators are sums over trips, so they give the same answer
on the roll-up as on the rows; persisting it once per month turns every
report into a scan of a table that is orders of magnitude smaller than the
raw feed (about 17 M rows per month collapse to the distinct hourly keys).
Row-level checks (blank text, NULL counts) keep reading the clean rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from cityrhythm import schema
from cityrhythm.functions.calendar import day_type, iso_weekday
from cityrhythm.model import with_calendar
from cityrhythm.operators import P, PASSAGE
from cityrhythm.sources import versioned

KEYS = ["transition_date", "transition_hour", "road_type", "product_kind",
        "line_name", "station_poi_desc_cd", "town"]
STORED = KEYS + [P, PASSAGE, "satir", "farkli_satir", "yil", "ay"]


def stored_schema(rollup: DataFrame) -> StructType:
    return rollup.select(*STORED).schema


def hourly_rollup(trips: DataFrame) -> DataFrame:
    """Aggregate trips to the hourly key. Calendar columns are re-derived from
    the date so the result has the trips schema (plus ``satir``/``farkli_satir``)."""
    g = trips.groupBy(*KEYS).agg(
        F.sum(P).alias(P), F.sum(PASSAGE).alias(PASSAGE),
        F.count(F.lit(1)).alias("satir"),
        F.count_if(F.col(PASSAGE) != F.col(P)).alias("farkli_satir"))
    return with_calendar(g)


def write_rollup(rollup: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist partitioned by year and month (a year scope prunes partitions);
    the table at ``path`` is replaced."""
    # contiguous date ranges per task (bounds sampled, so tasks are balanced):
    # a month is spread over several tasks and each task writes into one or two
    # month folders, instead of every task writing a small file into every month
    (rollup.select(*STORED).repartitionByRange("transition_date", "transition_hour")
     .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("yil", "ay")
     .option("compression", "zstd").parquet(path))


def read_rollup(spark: SparkSession, path: str, year: int | None = None,
                stored: StructType | None = None) -> DataFrame:
    """Read a written roll-up with the trips columns. ``yil`` and ``ay`` are its
    partition columns, so conditions on them prune. Pass ``stored`` (e.g.
    ``stored_schema(rollup)``) so that an empty roll-up (no data files) reads as
    an empty table."""
    reader = spark.read.schema(stored) if stored is not None else spark.read
    df = reader.parquet(path)
    if year is not None:
        df = df.where(F.col("yil") == year)
    d = F.col("transition_date")
    return df.select(*[c for c in STORED if c not in ("yil", "ay")], F.col("yil").cast("int").alias("yil"), F.col("ay").cast("int").alias("ay"),
                     iso_weekday(d).alias("haftanin_gunu"), day_type(d).alias("gun_tipi"))


# --- The kept roll-up of a store ---------------------------------------------

def kept_path(clean_path: str) -> str:
    """Where a store's roll-up is kept: beside the store, so each store has its own."""
    return clean_path.rstrip("/") + "_rollup"


def month_signatures(spark: SparkSession, clean_path: str) -> dict[int, str]:
    """What tells each source month's data from that of another time; no data file is opened."""
    return versioned.signatures(spark, clean_path)


def update(spark: SparkSession, clean_path: str, path: str | None = None) -> tuple[str, list[int]]:
    """Bring the kept roll-up up to date: months of the store that are new or
    changed since their roll-up are aggregated again, all others are left alone.
    Returns its path and the months written. It is a table of published versions
    like the store, so reports that read it meanwhile keep what they found; a
    month's manifest names the data it was made of. Partitioned by source month,
    then year and month of the date."""
    path = path or kept_path(clean_path)
    have, now = versioned.current(spark, path) or {}, month_signatures(spark, clean_path)
    todo = sorted(m for m, s in now.items() if m not in have or have[m].bilgi.get("imza") != s)
    written = []
    for m in todo:
        rows = with_calendar(versioned.read(spark, clean_path, months=[m]).where(F.col(schema.PERIOD_COL) == m))
        rollup = (hourly_rollup(rows).select(*STORED, F.lit(m).alias(schema.PERIOD_COL))
                  .repartitionByRange("transition_date", "transition_hour"))
        version = versioned.write(rollup, path, "yil", "ay")
        size = versioned.sizes(spark, path, version).get(m, (0, 0))
        if versioned.publish(spark, path, m, version, have[m].no if m in have else 0, size, {"imza": now[m]}):
            written.append(m)       # else another report has done it
    return path, written


# --- Kept daily totals ---------------------------------------------------------

DAILY = T.StructType([T.StructField("transition_date", T.DateType()), T.StructField("road_type", T.StringType()),
                      T.StructField(P, T.LongType()), T.StructField("satir", T.LongType())])


def daily_path(clean_path: str) -> str:
    return clean_path.rstrip("/") + "_gunluk"


def update_daily(spark: SparkSession, clean_path: str) -> list[int]:
    """Bring the kept daily totals (per source month, date and mode) up to date; only
    months that are new or changed are read, from the kept roll-up. Returns them."""
    path = daily_path(clean_path)
    rollup_path, _ = update(spark, clean_path)
    have, now = versioned.current(spark, path) or {}, versioned.current(spark, rollup_path) or {}
    todo = sorted(m for m, v in now.items() if m not in have or have[m].bilgi.get("imza") != v.surum)
    if not todo:
        return []
    rows = versioned.read(spark, rollup_path, kept_schema(), months=todo)
    days = rows.groupBy(schema.PERIOD_COL, "transition_date", "road_type").agg(F.sum(P).alias(P), F.sum("satir").alias("satir"))
    version = versioned.write(days.coalesce(1), path)       # some hundred rows a month
    sizes = versioned.sizes(spark, path, version)
    return [m for m in todo if versioned.publish(spark, path, m, version, have[m].no if m in have else 0, sizes.get(m, (0, 0)), {"imza": now[m].surum})]


def kept_daily(spark: SparkSession, clean_path: str, year: int | None = None) -> DataFrame:
    """Up-to-date daily totals with the calendar columns: what C4, C10-C12, C21 and C22 need of the trips."""
    update_daily(spark, clean_path)
    df = versioned.read(spark, daily_path(clean_path), DAILY)
    if year is not None:
        df = df.where(F.col(schema.PERIOD_COL).between(year * 100 + 1, year * 100 + 12))
    return with_calendar(df)


def kept_schema() -> StructType:
    return T.StructType([*[f for f in schema.CLEAN_SCHEMA.fields if f.name in KEYS], T.StructField(P, T.LongType()),
                         T.StructField(PASSAGE, T.LongType()), T.StructField("satir", T.LongType()), T.StructField("farkli_satir", T.LongType()),
                         T.StructField(schema.PERIOD_COL, T.IntegerType()), T.StructField("yil", T.IntegerType()), T.StructField("ay", T.IntegerType())])


def kept(spark: SparkSession, clean_path: str, year: int | None = None) -> DataFrame:
    """The up-to-date roll-up of a store, optionally of one year of source months
    (like :func:`cityrhythm.model.trips`)."""
    path, _ = update(spark, clean_path)
    df = versioned.read(spark, path, kept_schema())
    if year is not None:
        df = df.where(F.col(schema.PERIOD_COL).between(year * 100 + 1, year * 100 + 12))
    d = F.col("transition_date")
    return df.select(*[c for c in STORED if c not in ("yil", "ay")], "yil", "ay", iso_weekday(d).alias("haftanin_gunu"), day_type(d).alias("gun_tipi"))
