"""CSV -> clean Parquet ingest.

All new monthly files are parsed once into a quarantine staging table; the
gate (a single aggregation per file and date) reads three columns of it, and
the accepted files are copied into the month-partitioned store: one file a
month, the first accepted one in name order. Nothing lands before its file
passed the gate (quarantine, not filter). A month becomes visible by its
manifest alone (:mod:`cityrhythm.sources.versioned`), which also carries the
decision: a run killed at any point leaves each month either as it was or
converted, and of runs side by side one lands a month. Decisions go to a small
conversion-log table too; what a killed run published but did not log is
entered by the next one.

Staging tables stay under ``ingest/`` in the folder of ``spark.checkpoint.dir``
as evidence of what was judged; no later run reads them, so the folder's owner
may clear those of finished runs at any time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityrhythm import dims, schema
from cityrhythm.functions import blank_to_null
from cityrhythm.operators.autopsy import month_gate
from cityrhythm.session import work_path
from cityrhythm.sources import raw_csv, versioned

LOG_SCHEMA = T.StructType([
    T.StructField(schema.PERIOD_COL, T.IntegerType(), True),
    T.StructField(schema.SOURCE_COL, T.StringType(), False),
    T.StructField("durum", T.StringType(), False),        # donusturuldu | reddedildi | atlandi
    T.StructField("neden", T.StringType(), True),
    T.StructField("tam_gun", T.IntegerType(), True),
    T.StructField("ay_gun", T.IntegerType(), True),
    T.StructField("csv_mb", T.DoubleType(), True),
    T.StructField("parquet_mb", T.DoubleType(), True),
    T.StructField("zaman", T.TimestampType(), False),
])

CONVERTED, REJECTED, SKIPPED = "donusturuldu", "reddedildi", "atlandi"


RAW_HOUR = "transition_hour_ham"     # the hour as written in the file (staging only)


def with_raw_hour(raw: DataFrame) -> DataFrame:
    """Keep the hour text next to the row so the gate can count it as written."""
    return raw.select("*", F.col("transition_hour").alias(RAW_HOUR))


def gate_input(staged: DataFrame) -> DataFrame:
    """The staged rows as the gate sees them: the hour as the file's text, so
    "0" and "00" on one day count as two hours, like the definition."""
    return staged.select(schema.SOURCE_COL, schema.PERIOD_COL, "dosya_bayt", "transition_date",
                         F.col(RAW_HOUR).alias("transition_hour"), INVALID)


FILE_KEYS = [schema.SOURCE_COL, schema.PERIOD_COL, "dosya_bayt"]


def judge(staged: DataFrame, min_rows: int, done: Iterable[int] = (), force: bool = False) -> list[tuple[Row, str, str | None]]:
    """One aggregation over the staged rows: (gate row, decision, reason) per
    file, in name order. Of the accepted files of a month the first one in name
    order is converted; the others, and all of months in ``done``, are skipped."""
    gate = month_gate(gate_input(staged), min_rows, by=FILE_KEYS, flag=INVALID).collect()
    taken, out = set(done), []
    for g in sorted(gate, key=lambda g: raw_csv.file_name(g[schema.SOURCE_COL])):
        if g[schema.PERIOD_COL] in taken:
            out.append((g, SKIPPED, "zaten var"))
        elif g[INVALID]:
            out.append((g, REJECTED, "gecersiz deger"))
        elif g["kabul"] or force:
            taken.add(g[schema.PERIOD_COL])
            out.append((g, CONVERTED, None if g["kabul"] else "force"))
        else:
            out.append((g, REJECTED, "eksik/bozuk"))
    return out


def copy_accepted(staged: DataFrame, files: list[str], clean_path: str) -> str:
    """Copy the rows of these staged files (one a month) as the data of a new
    version of the store, which no reader sees yet; returns its id."""
    months = sorted({int(raw_csv.month_of(f)) for f in files})
    rows = (staged.where(F.col(schema.PERIOD_COL).isin(months) & F.col(schema.SOURCE_COL).isin(files))
            .drop(schema.SOURCE_COL, raw_csv.FILE_NAME, "dosya_bayt", RAW_HOUR, INVALID))
    return versioned.write(rows, clean_path)


INVALID = "gecersiz"      # staging only: a non-blank value that does not parse


def clean(raw: DataFrame, strict: bool = True) -> DataFrame:
    """A2: cast hour and mode id to tinyint and the counts to int; trim-blank
    -> NULL on line, town, line_name, station; other text kept verbatim.
    Column names and order follow the contract; source columns are carried.

    ``strict``: a value that does not cast (e.g. a non-numeric hour) fails
    the job. With ``strict=False`` it becomes NULL and the row gets an
    ``INVALID`` flag, so ingest can reject just that file."""
    c = F.col
    cols, bad = [], []
    for f in schema.CLEAN_SCHEMA.fields:
        if f.name in schema.BLANK_TO_NULL:
            cols.append(blank_to_null(f.name).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(c(f.name))
        elif strict:
            cols.append(c(f.name).cast(f.dataType).alias(f.name))
        else:
            v = c(f.name).try_cast(f.dataType)
            cols.append(v.alias(f.name))
            bad.append(c(f.name).isNotNull() & (F.trim(c(f.name)) != F.lit("")) & v.isNull())
    extra = [x for x in (schema.SOURCE_COL, raw_csv.FILE_NAME, schema.PERIOD_COL, "dosya_bayt", RAW_HOUR)
             if x in raw.columns]
    if not strict:
        if raw_csv.CORRUPT in raw.columns:                 # a malformed line (permissive read)
            bad.append(c(raw_csv.CORRUPT).isNotNull())
        flag = bad[0]
        for b in bad[1:]:
            flag = flag | b
        extra.append(flag.alias(INVALID))
    return raw.select(*cols, *extra)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The conversion log; empty if there is none yet. A log that can't be read is an error."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(log_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def converted_months(spark: SparkSession, log_path: str) -> set[int]:
    """A10: months already converted (the log has one row per decision)."""
    rows = read_log(spark, log_path).where(F.col("durum") == CONVERTED).select(schema.PERIOD_COL).distinct().collect()
    return {r[0] for r in rows}


def _notes(row: tuple) -> dict[str, str]:
    """A log row's fields as the notes of a manifest, and back by :func:`_from_notes`."""
    return {f.name: str(v) for f, v in zip(LOG_SCHEMA.fields, row) if v is not None and f.name != "zaman"}


def _from_notes(v: versioned.Version) -> tuple:
    kinds = {"integer": int, "double": float, "string": str}
    row = [None if f.name not in v.bilgi else kinds[f.dataType.typeName()](v.bilgi[f.name]) for f in LOG_SCHEMA.fields[:-1]]
    return (*row, dt.datetime.fromisoformat(v.zaman))


@dataclass
class IngestResult:
    report: DataFrame          # one row per file handled in this run
    accepted: list[int]        # months written


def ingest(spark: SparkSession, raw_dir: str, clean_path: str, log_path: str,
           months: Iterable[str] | None = None, min_rows: int = dims.MIN_ROWS_PER_DAY,
           force: bool = False) -> IngestResult:
    """Validate-gate-convert all new monthly files in one pass.

    * A11 ``months`` selects YYYYMM tokens; none found raises.
    * A10 months already converted (per the log) are skipped; raw files are never touched.
    * A3 a file missing a contract column is rejected; columns in another
      order or extra columns are read by name (the validator still flags them).
    * A6 the gate: full days (24 hours and >= ``min_rows`` rows) must equal
      the days of the first date's month; A12 ``force`` skips it.
    * A9 one accepted file a month (the first in name order; others are logged
      as skipped) is written as ZSTD Parquet partitioned by month and published
      by the month's manifest; readers use ``model.trips`` or ``versioned.read``.
    * A13 the report has CSV and Parquet sizes per month.
    """
    return ingest_files(spark, raw_csv.list_month_files(spark, raw_dir, months), clean_path, log_path, min_rows, force)


def ingest_files(spark: SparkSession, files: Sequence[str], clean_path: str, log_path: str,
                 min_rows: int = dims.MIN_ROWS_PER_DAY, force: bool = False) -> IngestResult:
    """:func:`ingest` for the given monthly files."""
    now = dt.datetime.now()
    published = versioned.current(spark, clean_path) or {}
    logged = converted_months(spark, log_path)
    # a killed run may have published a month that it did not log
    behind = [_from_notes(v) for m, v in sorted(published.items()) if m not in logged and "durum" in v.bilgi]
    if behind:
        versioned.append(spark.createDataFrame(behind, LOG_SCHEMA), log_path)
    done = logged | set(published)
    report: list[tuple] = []
    todo = []
    for f in files:
        m = int(raw_csv.month_of(f))
        if m in done:
            report.append((m, f, SKIPPED, "zaten var", None, None, None, None, now))
        else:
            todo.append(f)

    accepted: list[int] = []
    if todo:
        heads = {r[schema.SOURCE_COL]: (r["sema_ok"], r["adla_okunur"], r["gelen"])
                 for r in raw_csv.check_headers(spark, todo).collect()}
        for f in todo:
            if not heads[f][1]:
                report.append((int(raw_csv.month_of(f)), f, REJECTED, "sema", None, None, None, None, now))
        exact = [f for f in todo if heads[f][0]]
        by_name = {f: heads[f][2] for f in todo if heads[f][1] and not heads[f][0]}
        good = exact + list(by_name)
        if good:
            # The one CSV parse: all new files are cleaned into a quarantine
            # staging table (month-partitioned ZSTD Parquet in the shared
            # checkpoint folder). No repartition: every scan split belongs to
            # one file, so a large month is spread over as many tasks as it has
            # splits. Nothing reaches the clean store before the gate.
            stage = work_path(spark, f"ingest/stage-{uuid.uuid4().hex}")
            # contract-ordered files are read positionally; files whose columns
            # are reordered or extended are read by column name
            parts = ([raw_csv.read_raw(spark, exact, permissive=True)] if exact else []) + \
                    ([raw_csv.read_by_header(spark, list(by_name), by_name)] if by_name else [])
            raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
            staging = clean(with_raw_hour(raw), strict=False)
            staging.write.partitionBy(schema.PERIOD_COL).option("compression", "zstd").parquet(stage)
            staged = spark.read.schema(staging.schema).parquet(stage)     # also when no row was staged
            decisions = judge(staged, min_rows, force=force)
            seen = {raw_csv.file_name(g[schema.SOURCE_COL]) for g, _, _ in decisions}
            for f in good:
                if raw_csv.file_name(f) not in seen:                   # a header without rows
                    report.append((int(raw_csv.month_of(f)), f, REJECTED, "bos dosya", None, None, None, None, now))
            ok_files = [g[schema.SOURCE_COL] for g, what, _ in decisions if what == CONVERTED]
            version, sizes = None, {}
            if ok_files:
                version = copy_accepted(staged, ok_files, clean_path)
                sizes = versioned.sizes(spark, clean_path, version)
            for g, what, why in decisions:
                m = g[schema.PERIOD_COL]
                size = sizes.get(m, (0, 0))
                row = (m, g[schema.SOURCE_COL], what, why, g["tam_gun"], g["ay_gun"], (g["dosya_bayt"] or 0) / 1e6,
                       size[0] / 1e6 if what == CONVERTED else None, now)
                if what == CONVERTED:
                    if versioned.publish(spark, clean_path, m, version, 0, size, _notes(row)):
                        accepted.append(m)
                    else:       # another run published the month in the meantime
                        row = (m, g[schema.SOURCE_COL], SKIPPED, "zaten var", None, None, None, None, now)
                report.append(row)

    rep = spark.createDataFrame(report, LOG_SCHEMA)
    if report:
        versioned.append(rep, log_path)
    return IngestResult(rep, sorted(accepted))


def parquet_sizes(spark: SparkSession, clean_path: str, months: list[int] | None = None) -> dict[int, float]:
    """MB of Parquet per month, from the manifests, or from the status of a
    plain table's files (none is opened)."""
    versions = versioned.current(spark, clean_path)
    if versions is not None:
        return {m: v.bayt / 1e6 for m, v in versions.items() if months is None or m in set(months)}
    files = versioned.listing(spark, clean_path)
    if months is not None:
        files = files.where(F.col(schema.PERIOD_COL).isin(months))
    return {r[0]: r["mb"] for r in files.groupBy(schema.PERIOD_COL).agg((F.sum("length") / F.lit(1e6)).alias("mb")).collect()}
