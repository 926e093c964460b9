"""Data-autopsy profile (D1-D9) and the row-level quality measures shared with
validation (A4, A5, A6, A8).

These need row-level input (counts of rows, blanks, NULLs). ``by`` groups the
checks per source file when many monthly files are checked in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from cityrhythm import dims, schema
from cityrhythm.functions import days_in_month, is_blank, ratio
from cityrhythm.operators import P, PASSAGE
from cityrhythm.sources import versioned


def _count():
    return F.count(F.lit(1))


def overview(df: DataFrame, sample: int = 5) -> tuple[DataFrame, list[tuple[str, str]], DataFrame]:
    """Row count (as a one-row DataFrame), column/type listing, sample rows."""
    return df.agg(_count().alias("satir_sayisi")), df.dtypes, df.limit(sample)


def month_coverage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4: rows, first/last date, distinct days, days of the first date's month
    and the number of days missing from it."""
    d = F.col("transition_date")
    return (df.groupBy(*by).agg(
                _count().alias("satir"), F.min(d).alias("ilk_gun"), F.max(d).alias("son_gun"),
                F.count_distinct(d).alias("gun_sayisi"), days_in_month(F.min(d)).alias("ay_gun"))
            .withColumn("eksik_gun", F.col("ay_gun") - F.col("gun_sayisi")))


def store_coverage(spark: SparkSession, clean_path: str) -> DataFrame:
    """A4, D1 over a clean store: rows, first and last day of each source month, from the Parquet footers alone.

    Spark's second Parquet reader answers counts and extremes from the footers.
    It is chosen by session settings, so the result belongs to a session of its
    own with these, and the caller's is left as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    d = F.col("transition_date")
    rows = versioned.read(own, clean_path, schema.CLEAN_SCHEMA, version=True)
    # footers are enough only for groups of all partition columns; a month has one version
    parts = [c for c in (versioned.VERSION_COL, schema.PERIOD_COL) if c in rows.columns]
    return rows.groupBy(*parts).agg(_count().alias("satir"), F.min(d).alias("ilk_gun"), F.max(d).alias("son_gun")).drop(versioned.VERSION_COL)


# --- Mergeable state of a day (A5, D2, D3) ------------------------------------
#
# The hours 0-23 are bits of an int, so two parts of a day are united by
# bit_or and no distinct count needs a shuffle of its own. An hour written
# another way ("0" beside "00", "24") is a text of its own.

HOUR_BITS, HOUR_OTHERS, HOUR_NULL = "saat_bit", "saat_diger", "saat_bos"


def _hour_state(df: DataFrame) -> tuple[Column, Column]:
    """The bit of a row's hour, or its text if it has no bit."""
    h = F.col("transition_hour")
    if isinstance(df.schema["transition_hour"].dataType, StringType):
        n = F.when(h.rlike("^([01][0-9]|2[0-3])$"), h.try_cast("int"))
    else:
        n = F.when(h.between(0, 23), h.cast("int"))
    return F.call_function("shiftleft", F.lit(1), n), F.when(n.isNull(), h.cast("string"))


def day_state(df: DataFrame, by: Sequence[str] = (), flag: str | None = None, passengers: bool = False) -> DataFrame:
    """Per group and day: hour set, rows (and passengers, and whether ``flag`` is true in any row), in one aggregation.

    States of parts of a day are united by :func:`merge_states`, in any order and grouping.
    """
    bit, other = _hour_state(df)
    return df.groupBy(*by, "transition_date").agg(
        F.coalesce(F.bit_or(bit), F.lit(0)).alias(HOUR_BITS), F.array_sort(F.collect_set(other)).alias(HOUR_OTHERS),
        F.bool_or(F.col("transition_hour").isNull()).alias(HOUR_NULL), _count().alias("satir"),
        *([] if flag is None else [F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag)]),
        *([F.sum(P).alias("yolcu")] if passengers else []))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per group and day from states of parts (stored per file, per delivery or per batch)."""
    own = {*by, "transition_date", HOUR_BITS, HOUR_OTHERS, HOUR_NULL, "satir", "yolcu"}
    flags = [f.name for f in states.schema.fields if f.name not in own and isinstance(f.dataType, BooleanType)]
    return states.groupBy(*by, "transition_date").agg(
        F.bit_or(HOUR_BITS).alias(HOUR_BITS), F.array_sort(F.array_distinct(F.flatten(F.collect_list(HOUR_OTHERS)))).alias(HOUR_OTHERS),
        F.bool_or(HOUR_NULL).alias(HOUR_NULL), F.sum("satir").alias("satir"), *[F.bool_or(f).alias(f) for f in flags],
        *([F.sum("yolcu").alias("yolcu")] if "yolcu" in states.columns else []))


def _hours() -> Column:
    """Distinct hours of a state, NULL not counted."""
    return (F.bit_count(HOUR_BITS) + F.size(HOUR_OTHERS)).cast("long")


def coverage_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Date span, distinct days, distinct (day, hour) pairs (a pair with a
    NULL part counts) vs the month's days x 24."""
    return coverage_of_states(day_state(df, by), by)


def coverage_of_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`coverage_pairs` from day states, one a day."""
    d = F.col("transition_date")
    pairs = F.coalesce(F.sum(_hours() + F.col(HOUR_NULL).cast("int")), F.lit(0))
    return states.groupBy(*by).agg(
        F.min(d).alias("ilk_gun"), F.max(d).alias("son_gun"), F.count(d).alias("gun_sayisi"),
        pairs.alias("dolu_kombinasyon"), (days_in_month(F.min(d)) * F.lit(24)).alias("beklenen_kombinasyon"))


def day_completeness(df: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY,
                     by: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """A5: per day distinct hours and rows; full = 24 hours and rows >= threshold;
    broken = fewer hours or fewer rows. ``flag``: a boolean column carried
    along, true if it is in any row."""
    return completeness_of_states(day_state(df, by, flag), min_rows, by, flag)


def completeness_of_states(states: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY, by: Sequence[str] = (),
                           flag: str | None = None) -> DataFrame:
    """:func:`day_completeness` from day states, one a day."""
    g = states.withColumn("saat", _hours())
    return g.select(*by, "transition_date", "saat", "satir",
                    ((F.col("saat") == 24) & (F.col("satir") >= min_rows)).alias("tam"),
                    ((F.col("saat") < 24) | (F.col("satir") < min_rows)).alias("kirik"), *([] if flag is None else [flag]))


def month_gate(df: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY, by: Sequence[str] = (),
               flag: str | None = None) -> DataFrame:
    """Accept iff the number of full days equals the days of the first
    date's month (a stray partial day outside the month is ignored; more full
    days than the month has is a rejection)."""
    return gate_of_states(day_state(df, by, flag), min_rows, by, flag)


def gate_of_states(states: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY, by: Sequence[str] = (),
                   flag: str | None = None) -> DataFrame:
    """:func:`month_gate` from day states, one a day: a month that came in parts is judged without its rows."""
    days = completeness_of_states(states, min_rows, by, flag)
    return (days.groupBy(*by).agg(
                F.count_if(F.col("tam")).cast("int").alias("tam_gun"),
                days_in_month(F.min("transition_date")).alias("ay_gun"),
                *([] if flag is None else [F.bool_or(flag).alias(flag)]))
            .withColumn("kabul", F.col("tam_gun") == F.col("ay_gun")))


def null_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Blank town %, blank line % and NULL passenger % and count."""
    n = _count()
    return df.groupBy(*by).agg(
        ratio(F.count_if(is_blank("town")), n, 100.0).alias("town_bos_pct"),
        ratio(F.count_if(is_blank("line_name")), n, 100.0).alias("hat_bos_pct"),
        ratio(F.count_if(F.col(P).isNull()), n, 100.0).alias("yolcu_bos_pct"),
        F.count_if(F.col(P).isNull()).alias("yolcu_bos"),
        n.alias("toplam"))


def day_profile(df: DataFrame) -> DataFrame:
    """D3: per day filled hours, rows and passengers."""
    return day_state(df, passengers=True).select("transition_date", _hours().alias("dolu_saat"), "satir", "yolcu")


def mode_map(df: DataFrame, with_id: bool = False) -> DataFrame:
    """Mode (id and) name with rows and passengers."""
    keys = (["transport_type_id"] if with_id else []) + ["road_type"]
    return df.groupBy(*keys).agg(_count().alias("satir"), F.sum(P).alias("yolcu"))


def town_count(df: DataFrame) -> DataFrame:
    """Number of distinct towns (NULL not counted)."""
    return df.agg(F.count_distinct("town").alias("ilce_sayisi"))


def town_top(df: DataFrame, n: int = 10) -> DataFrame:
    """Top-``n`` towns by passengers (NULL town is a group of its own)."""
    return (df.groupBy("town").agg(_count().alias("satir"), F.sum(P).alias("yolcu"))
            .orderBy(F.col("yolcu").desc_nulls_last(), F.col("town").asc_nulls_last()).limit(n))


def line_stations(df: DataFrame, line: str, n: int = 8) -> DataFrame:
    """Stations and towns of one line, top-``n`` by passengers."""
    return (df.where(F.col("line_name") == F.lit(line))
            .groupBy("line_name", "station_poi_desc_cd", "town").agg(F.sum(P).alias("yolcu"))
            .orderBy(F.col("yolcu").desc_nulls_last(), F.col("station_poi_desc_cd").asc_nulls_last(),
                     F.col("town").asc_nulls_last()).limit(n))


def line_towns(df: DataFrame, line: str) -> DataFrame:
    """The (long route, town) pairs one road line is written to."""
    return (df.where(F.col("line_name") == F.lit(line))
            .groupBy("line_name", "line", "town").agg(_count().alias("satir")))


def blank_town_lines(df: DataFrame, n: int = 5) -> DataFrame:
    """Lines whose town is blank, top-``n`` by passengers."""
    return (df.where(is_blank("town"))
            .groupBy("road_type", "line_name").agg(_count().alias("satir"), F.sum(P).alias("yolcu"))
            .orderBy(F.col("yolcu").desc_nulls_last(), F.col("road_type").asc_nulls_last(),
                     F.col("line_name").asc_nulls_last()).limit(n))


def passage_vs_passenger(df: DataFrame) -> DataFrame:
    """Passages vs passengers; rows where they differ (NULL is not counted)."""
    return df.agg(F.sum(PASSAGE).alias("gecis"), F.sum(P).alias("yolcu"),
                  F.count_if(F.col(PASSAGE) != F.col(P)).alias("farkli_satir"),
                  _count().alias("toplam_satir"))


def null_map(df: DataFrame) -> DataFrame:
    """D9 / A8 by mode: blank station, town and line counts per road type."""
    return df.groupBy("road_type").agg(
        _count().alias("satir"),
        F.count_if(is_blank("station_poi_desc_cd")).alias("istasyon_bos"),
        F.count_if(is_blank("town")).alias("town_bos"),
        F.count_if(is_blank("line_name")).alias("hat_bos"))
