"""Raw monthly CSV files ``hourly_transportation_YYYYMM.csv``.

Files are listed through Spark's file index (``DataFrame.inputFiles``), so
listing works on any Hadoop-compatible store and reads no data. Headers are
checked before the rows are read: with an explicit schema Spark maps CSV
columns by position, so a file with swapped or extra columns must be caught
first rather than silently mis-read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityrhythm import schema

PATTERN = "hourly_transportation_*.csv"
_MONTH_RE = re.compile(r"_(\d{6})\.csv$")


# Per-file results are joined on the file *name*: the listing and the row
# metadata spell the same local path differently (file:/// vs file:/).
FILE_NAME = "dosya_adi"


def file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def month_of(path: str) -> str | None:
    m = _MONTH_RE.search(path)
    return m.group(1) if m else None


def list_month_files(spark: SparkSession, raw_dir: str, months: Iterable[str] | None = None) -> list[str]:
    """The monthly files under ``raw_dir``, optionally only the given
    YYYYMM months; raises when none is found."""
    try:
        files = spark.read.option("pathGlobFilter", PATTERN).text(raw_dir).inputFiles()
    except Exception as e:   # an empty or missing folder
        raise FileNotFoundError(f"no monthly CSV under {raw_dir}: {e}") from None
    files = sorted(f for f in files if month_of(f))
    wanted = set(months or [])
    if wanted:
        files = [f for f in files if month_of(f) in wanted]
    if not files:
        raise FileNotFoundError(f"no monthly CSV to process under {raw_dir} (filter: {sorted(wanted) or 'none'})")
    return files


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file as written in its header line.

    Spark reads only the first line for this (no schema inference).
    """
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def headers(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """Every file's column names, as Spark's reader names them, by one job whatever the number of files.

    The file names are dealt out and tasks read each file's first line. Where
    Arrow does not know the store, Spark reads the lines, a small job a file.
    """
    if not files:
        return {}
    try:
        for root in {f.rsplit("/", 1)[0] for f in files}:
            pa.fs.FileSystem.from_uri(_uri(root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        with ThreadPoolExecutor(max_workers=min(16, len(files))) as pool:
            return dict(zip(files, pool.map(lambda f: header_of(spark, f), files)))
    most = 1 << 20      # bytes of a header line

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        import pyarrow as pa
        import pyarrow.fs as pfs
        for batch in batches:
            out = []
            for uri in batch["uri"].to_pylist():
                fs, path = pfs.FileSystem.from_uri(uri)
                data = b""
                with fs.open_input_stream(path, compression=None) as f:
                    while b"\n" not in data and len(data) < most:
                        more = f.read(1 << 16)
                        if not more:
                            break
                        data += more
                line = data.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace")
                names = next(csv.reader([line]), []) if line else []
                low = [n.lower() for n in names]
                out.append([f"_c{i}" if not n else f"{n}{i}" if low.count(low[i]) > 1 else n for i, n in enumerate(names)])
            yield pa.record_batch([batch["dosya"], pa.array(out, pa.list_(pa.string()))], names=["dosya", "gelen"])

    listed = spark.createDataFrame([(f, _uri(f)) for f in files], "dosya string, uri string").repartition(min(len(files), 1000))
    return {r["dosya"]: list(r["gelen"]) for r in listed.mapInArrow(first_lines, "dosya string, gelen array<string>").collect()}


def _uri(path: str) -> str:
    """A path as Arrow reads it: ``file:/x`` is ``file:///x``."""
    return "file://" + path[len("file:"):] if path.startswith("file:") and not path.startswith("file://") else path


def check_headers(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """A3: (kaynak_dosya, dosya_adi, sema_ok, adla_okunur, gelen) — whether the
    ordered header equals the contract, and whether it at least contains every
    contract column (then the file can be read by column name). One job for all
    files, a row a file.
    """
    found = headers(spark, files)
    rows = [(f, file_name(f), got == schema.RAW_COLUMNS, set(schema.RAW_COLUMNS) <= set(got), got)
            for f in files for got in [found[f]]]
    sch = T.StructType([
        T.StructField(schema.SOURCE_COL, T.StringType(), False),
        T.StructField(FILE_NAME, T.StringType(), False),
        T.StructField("sema_ok", T.BooleanType(), False),
        T.StructField("adla_okunur", T.BooleanType(), False),    # all contract columns present (any order)
        T.StructField("gelen", T.ArrayType(T.StringType()), False),
    ])
    return spark.createDataFrame(rows, sch)


def _with_source(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias(schema.SOURCE_COL), F.col("_metadata.file_name").alias(FILE_NAME),
                     F.col("_metadata.file_size").alias("dosya_bayt"),
                     F.regexp_extract(path, r"_(\d{6})\.csv$", 1).cast("int").alias(schema.PERIOD_COL))


CORRUPT = "bozuk_satir"     # the text of a line that does not split into the contract's fields


def read_raw(spark: SparkSession, files: Sequence[str], permissive: bool = False) -> DataFrame:
    """A1: the 13 contract columns as text, plus source file, its size and the
    YYYYMM month taken from the file name. Use only on files whose header
    passed :func:`check_headers` (columns are taken by position).

    A malformed line fails the read; with ``permissive=True`` it is kept with
    its text in ``CORRUPT`` instead, so ingest can reject just that file."""
    # enforceSchema=false is a second net: Spark checks every file's header
    # against the contract while reading (e.g. a file replaced after the check)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if permissive:
        sch = T.StructType(list(schema.RAW_SCHEMA.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
        reader = reader.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    else:
        reader = reader.schema(schema.RAW_SCHEMA).option("mode", "FAILFAST")
    return _with_source(reader.csv(list(files)))


def read_by_header(spark: SparkSession, files: Sequence[str], known: Mapping[str, Sequence[str]] | None = None) -> DataFrame | None:
    """Read files whose header differs from the contract by column *name*
    (text only), keeping the contract columns when all of them are present;
    used by validation to still profile such files; ``known`` are their headers
    if they were read already. Files of one header are read together. Returns
    None when no file has all contract columns."""
    parts = []
    of: dict[tuple[str, ...], list[str]] = {}
    for f, names in (headers(spark, files) if known is None else known).items():
        if f in set(files):
            of.setdefault(tuple(names), []).append(f)
    for names, same in sorted(of.items(), key=lambda x: x[1]):
        if not set(schema.RAW_COLUMNS) <= set(names):
            continue
        # the file's own header as an all-text schema, plus the corrupt-record
        # column: a malformed line is kept and flagged, as in read_raw(permissive)
        sch = T.StructType([T.StructField(n, T.StringType(), True) for n in names]
                           + [T.StructField(CORRUPT, T.StringType(), True)])
        df = (spark.read.schema(sch).option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(same))
        parts.append(_with_source(df.select(*schema.RAW_COLUMNS, CORRUPT)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
