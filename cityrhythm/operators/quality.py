"""Validation report over raw monthly files.

One aggregation pass per (file, date) carries rows, the hour set, blank and
NULL counts; the file-level numbers roll up from it. The verdict is a row per
file with the list of reasons, and the overall verdict is the AND over files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm import dims, schema
from cityrhythm.functions import days_in_month, is_blank, ratio
from cityrhythm.sources import raw_csv

COMPLETE, PROBLEM = "TAM", "EKSIK/SORUNLU"


def _typed(raw: DataFrame) -> DataFrame:
    # Dates and counts are typed for the checks; the hour stays text like the
    # raw file (distinct hour texts are counted). A date or count that does not
    # parse is reported (as a NULL date / NULL passenger) instead of failing.
    corrupt = F.col(raw_csv.CORRUPT) if raw_csv.CORRUPT in raw.columns else F.lit(None).cast("string")
    return raw.select(
        raw_csv.FILE_NAME,
        F.col("transition_date").try_cast("date").alias("transition_date"),
        "transition_hour", "town", "line_name",
        F.col("number_of_passenger").try_cast("int").alias("number_of_passenger"),
        corrupt.isNotNull().alias("_bozuk"),
        # a hash of the whole line: the file checksum below needs every field,
        # so the reader parses full lines (only then are malformed lines seen)
        F.xxhash64(*[F.col(c) for c in schema.RAW_COLUMNS]).alias("_ozet"))


def file_stats(rows: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY) -> DataFrame:
    """Per file: rows, first/last day, distinct days, days of the month of the
    first day, full / broken day counts and lists (broken: date, hours, rows),
    blank town / line, NULL passenger, NULL date and malformed rows, and an
    order-independent content checksum (XOR of row hashes) to spot a changed
    or re-downloaded file."""
    t = _typed(rows)
    day = t.groupBy(raw_csv.FILE_NAME, "transition_date").agg(
        F.count_distinct("transition_hour").alias("saat"),
        F.count(F.lit(1)).alias("satir"),
        F.count_if(is_blank("town")).alias("town_bos"),
        F.count_if(is_blank("line_name")).alias("hat_bos"),
        F.count_if(F.col("number_of_passenger").isNull()).alias("yolcu_bos"),
        F.count_if(F.col("_bozuk")).alias("bozuk"),
        F.bit_xor("_ozet").alias("ozet"))
    d = F.col("transition_date")
    full = (F.col("saat") == 24) & (F.col("satir") >= min_rows)
    broken = d.isNotNull() & ((F.col("saat") < 24) | (F.col("satir") < min_rows))
    return day.groupBy(raw_csv.FILE_NAME).agg(
        F.sum("satir").alias("satir"),
        F.min(d).alias("ilk_gun"), F.max(d).alias("son_gun"),
        F.count(d).alias("gun_sayisi"),
        days_in_month(F.min(d)).alias("ay_gun"),
        F.count_if(full).alias("tam_gun"),
        F.count_if(broken).alias("kirik_gun"),
        # the day lists are bounded by the days in a file (one row per day here)
        F.array_sort(F.collect_list(F.when(full, d))).alias("tam_gunler"),
        F.array_sort(F.collect_list(F.when(broken, F.struct(d.alias("tarih"), F.col("saat"), F.col("satir")))))
        .alias("kirik_gunler"),
        F.sum("town_bos").alias("town_bos"), F.sum("hat_bos").alias("hat_bos"),
        F.sum("yolcu_bos").alias("yolcu_bos"),
        F.sum("bozuk").alias("bozuk_satir"),
        F.bit_xor("ozet").alias("icerik_ozeti"),       # order-independent content checksum
        F.sum(F.when(d.isNull(), F.col("satir")).otherwise(F.lit(0))).alias("tarihsiz_satir"))


def broken_days(rows: DataFrame, min_rows: int = dims.MIN_ROWS_PER_DAY) -> DataFrame:
    """A5 detail: (file, date, hours, rows) of every broken day."""
    t = _typed(rows)
    g = t.groupBy(raw_csv.FILE_NAME, "transition_date").agg(
        F.count_distinct("transition_hour").alias("saat"), F.count(F.lit(1)).alias("satir"))
    return g.where((F.col("saat") < 24) | (F.col("satir") < min_rows))


def validate(spark: SparkSession, files: Sequence[str], min_rows: int = dims.MIN_ROWS_PER_DAY) -> DataFrame:
    """One verdict row per file.

    Reasons: ``sema`` (header differs from the contract), ``bos_dosya`` (no
    rows), ``bozuk_satir`` (a line that does not split into the 13 fields),
    ``eksik_gun`` (days
    of the month absent), ``kirik_gun`` (a day with < 24 hours or < ``min_rows``
    rows), ``null_yolcu`` (NULL passenger count), ``null_tarih`` (NULL date).
    Files with a different header are still profiled by column name when they
    carry all contract columns.
    """
    heads = raw_csv.check_headers(spark, files)
    found = {r[schema.SOURCE_COL]: r for r in heads.collect()}
    ok = [f for f in files if found[f]["sema_ok"]]
    bad = [f for f in files if not found[f]["sema_ok"]]
    parts = []
    if ok:
        parts.append(raw_csv.read_raw(spark, ok, permissive=True))
    if bad:
        by_name = raw_csv.read_by_header(spark, bad, {f: found[f]["gelen"] for f in bad})
        if by_name is not None:
            parts.append(by_name)
    stats = None
    for p in parts:
        stats = file_stats(p, min_rows) if stats is None else stats.unionByName(file_stats(p, min_rows))
    out = heads
    if stats is not None:
        out = heads.join(stats, raw_csv.FILE_NAME, "left")
    else:
        for c in ("satir", "gun_sayisi", "ay_gun", "kirik_gun", "yolcu_bos", "tarihsiz_satir", "town_bos", "hat_bos",
                  "bozuk_satir"):
            out = out.withColumn(c, F.lit(None).cast("long"))
    return verdict(out)


def verdict(out: DataFrame) -> DataFrame:
    """Reasons and decision from a file's header flags and :func:`file_stats`."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("sema_ok"), F.lit("sema")),
        F.when(F.col("adla_okunur") & (F.coalesce(F.col("satir"), F.lit(0)) == 0), F.lit("bos_dosya")),
        F.when(F.col("gun_sayisi") < F.col("ay_gun"), F.lit("eksik_gun")),
        F.when(F.col("kirik_gun") > 0, F.lit("kirik_gun")),
        F.when(F.col("yolcu_bos") > 0, F.lit("null_yolcu")),
        F.when(F.col("tarihsiz_satir") > 0, F.lit("null_tarih")),
        F.when(F.col("bozuk_satir") > 0, F.lit("bozuk_satir")),
    ))
    return out.select(
        "*",
        ratio("town_bos", "satir", 100.0).alias("town_bos_pct"),
        ratio("hat_bos", "satir", 100.0).alias("hat_bos_pct"),
        ratio("yolcu_bos", "satir", 100.0).alias("yolcu_bos_pct"),
        reasons.alias("nedenler"),
    ).withColumn("durum", F.when(F.size("nedenler") == 0, F.lit(COMPLETE)).otherwise(F.lit(PROBLEM)))


def overall(report: DataFrame) -> DataFrame:
    """A7 over many files: complete only if every file is."""
    return report.agg(F.bool_and(F.col("durum") == F.lit(COMPLETE)).alias("hepsi_tam"))
