"""Month tables with published versions.

A writer puts a version's data under ``<table>/_data/surum=<id>/``, where no
reader looks, and publishes a month by creating its next manifest
``<table>/_manifest/<month>/<number>.json``. That file appears whole or not at
all and is created only if absent, so a run that is killed before it leaves the
month as it was, of several writers of one number a single one wins, and a
reader that has listed the manifests keeps reading the versions it found.

A folder without manifests is read as a plain Parquet table.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityrhythm import schema

VERSION_COL = "surum"
MANIFEST = "ay int, no int, surum string, bayt long, dosya_sayisi long, zaman timestamp, bilgi map<string,string>"


@dataclass(frozen=True)
class Version:
    """What a month's manifest says: its number, the data's id, bytes and files, and the writer's notes."""

    ay: int
    no: int
    surum: str
    bayt: int = 0
    dosya_sayisi: int = 0
    zaman: str = ""
    bilgi: dict[str, str] = field(default_factory=dict)


def _root(table: str) -> str:
    return table.rstrip("/")


def data_path(table: str) -> str:
    return f"{_root(table)}/_data"


def manifests(spark: SparkSession, table: str) -> DataFrame | None:
    """All manifests of a table; None if it has none. Only a missing path counts as none, every other fault is raised."""
    try:
        return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{_root(table)}/_manifest/*/*.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, table: str) -> dict[int, Version] | None:
    """The last version of each month (one row a month is collected); None for a table without manifests."""
    found = manifests(spark, table)
    if found is None:
        return None
    last = found.groupBy("ay").agg(F.max_by(F.struct(*(f.name for f in found.schema.fields if f.name != "ay")), "no").alias("m"))
    return {r["ay"]: Version(r["ay"], r.m["no"], r.m["surum"], r.m["bayt"] or 0, r.m["dosya_sayisi"] or 0, str(r.m["zaman"]), r.m["bilgi"] or {})
            for r in last.collect()}


def write(df: DataFrame, table: str, *partitions: str) -> str:
    """Write rows of any months as a new version's data, partitioned by source month; returns its id. No reader sees it yet."""
    version = uuid.uuid4().hex
    (df.write.partitionBy(schema.PERIOD_COL, *partitions).option("compression", "zstd").parquet(f"{data_path(table)}/{VERSION_COL}={version}"))
    return version


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path (``path``, ``length``, ``modificationTime``, partition columns) from their status alone: no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).drop("content")


def sizes(spark: SparkSession, table: str, version: str) -> dict[int, tuple[int, int]]:
    """Bytes and files of each month that a version holds."""
    files = listing(spark, f"{data_path(table)}/{VERSION_COL}={version}")
    if schema.PERIOD_COL not in files.columns:      # no row was written
        return {}
    return {r[0]: (r["bayt"], r["n"]) for r in files.groupBy(schema.PERIOD_COL).agg(F.sum("length").alias("bayt"), F.count("*").alias("n")).collect()}


def publish(spark: SparkSession, table: str, month: int, version: str, seen: int, size: tuple[int, int] = (0, 0),
            notes: dict[str, str] | None = None) -> bool:
    """Make ``version`` the month's data, if its last manifest is still number ``seen`` (0: it has none). False: another writer was first."""
    entry = Version(month, seen + 1, version, *size, zaman=dt.datetime.now().isoformat(), bilgi=notes or {})
    return create_if_absent(spark, f"{_root(table)}/_manifest/{month}/{entry.no:08d}.json", json.dumps(asdict(entry)) + "\n")


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content at once; False if there is one already.

    The text goes to a hidden file beside it first, which then takes the name:
    by a hard link on a local disk, by a rename that does not overwrite on
    others (atomic on HDFS; an object store's connector has to offer it).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        return _link(fs.makeQualified(hidden), fs.makeQualified(target)) if fs.getUri().getScheme() == "file" else _rename(spark, fs, hidden, target)
    finally:
        fs.delete(hidden, False)


def _link(hidden, target) -> bool:
    try:
        os.link(hidden.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False


def _rename(spark: SparkSession, fs, hidden, target) -> bool:
    sc = spark.sparkContext
    names = sc._jvm.org.apache.hadoop.fs
    options = sc._gateway.new_array(sc._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename") and names.Options.Rename, 1)
    options[0] = names.Options.Rename.NONE
    try:
        names.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(hidden), fs.makeQualified(target), options)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def append(df: DataFrame, path: str) -> None:
    """Add few rows to a small Parquet table as one file that appears whole. Writers side by side don't disturb
    each other, as those that share an output folder's temporary files would."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    hidden = f"{_root(path)}/_{name}"
    df.coalesce(1).write.parquet(hidden)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(hidden).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, status in enumerate(fs.globStatus(Path(f"{hidden}/part-*.parquet"))):
        if not fs.rename(status.getPath(), Path(f"{_root(path)}/{name}-{n}.parquet")):
            raise OSError(f"{path}: could not append")
    fs.delete(Path(hidden), True)


def read(spark: SparkSession, table: str, columns: T.StructType | None = None, months: Iterable[int] | None = None,
         version: bool = False) -> DataFrame:
    """The published rows, with the source month as partition column; the data is read with the schema ``columns`` if given.
    ``version``: with the id of their version as a column (none for a plain table).

    The manifests are listed now; versions published later are not in this DataFrame.
    """
    versions = current(spark, table)
    if versions is None:
        return (spark.read if columns is None else spark.read.schema(_with_month(columns))).parquet(table)
    if months is not None:
        wanted = set(months)
        versions = {m: v for m, v in versions.items() if m in wanted}
    paths = [f"{data_path(table)}/{VERSION_COL}={v.surum}/{schema.PERIOD_COL}={m}" for m, v in sorted(versions.items()) if v.dosya_sayisi]
    if not paths:
        return spark.createDataFrame([], _with_month(columns or schema.CLEAN_SCHEMA))
    reader = spark.read.option("basePath", data_path(table))
    if columns is not None:
        reader = reader.schema(_with_month(columns).add(VERSION_COL, T.StringType()))
    rows = reader.parquet(*paths)
    return rows if version else rows.drop(VERSION_COL)


def _with_month(columns: T.StructType) -> T.StructType:
    has = {f.name for f in columns.fields}
    return T.StructType([*columns.fields] + ([] if schema.PERIOD_COL in has else [T.StructField(schema.PERIOD_COL, T.IntegerType())]))


def signatures(spark: SparkSession, table: str) -> dict[int, str]:
    """What tells a month's data from that of another time: its version, or for a plain table its files' names, sizes and times."""
    versions = current(spark, table)
    if versions is not None:
        return {m: v.surum for m, v in versions.items()}
    files = listing(spark, table).select(schema.PERIOD_COL, F.struct(F.element_at(F.split("path", "/"), -1).alias("f"), "length", "modificationTime").alias("x"))
    rows = files.groupBy(schema.PERIOD_COL).agg(F.sha2(F.to_json(F.sort_array(F.collect_list("x"))), 256).alias("imza")).collect()
    return {r[schema.PERIOD_COL]: r["imza"] for r in rows}


def vacuum(spark: SparkSession, table: str, older_than: dt.timedelta = dt.timedelta(days=7)) -> list[str]:
    """Delete the data of versions that no month's last manifest names and that are older than any running writer or reader can be."""
    versions = current(spark, table)
    if versions is None:
        return []
    keep = {v.surum for v in versions.values()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(data_path(table))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    before = (dt.datetime.now() - older_than).timestamp() * 1000
    gone = []
    for status in fs.listStatus(root):
        version = status.getPath().getName().removeprefix(f"{VERSION_COL}=")
        if version not in keep and status.getModificationTime() < before and fs.delete(status.getPath(), True):
            gone.append(version)
    return sorted(gone)
