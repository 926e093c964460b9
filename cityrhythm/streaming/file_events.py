"""A folder's monthly files as a stream of arrivals (A10).

A Python streaming source whose offset is what the folder held: each file's
modification time and size by name. A batch has a row for every file whose
entry is new or differs, so a file that comes again under its name comes again
in the stream, and one that arrives late with an old time is not missed. The
offset grows with the number of monthly files, not with their rows. The rows
name the files; their content is read by whoever takes them.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cityrhythm.sources.raw_csv import PATTERN

FORMAT = "city_file_arrivals"
SCHEMA = "yol string, ad string, bayt long, zaman_ns long"


def _source() -> type[DataSource]:
    # classes made here travel to Spark's Python workers by value: these need not find the package
    match = fnmatch.fnmatchcase

    class Files(InputPartition):
        def __init__(self, rows: list[tuple]):
            self.rows = rows

    class Reader(DataSourceStreamReader):
        def __init__(self, folder: str, pattern: str):
            self.folder, self.pattern = folder.rstrip("/"), pattern

        def _held(self) -> dict[str, list[int]]:
            import pyarrow.fs as pfs
            fs, root = pfs.FileSystem.from_uri(self.folder)
            found = fs.get_file_info(pfs.FileSelector(root, allow_not_found=True))
            return {f.base_name: [f.mtime_ns or 0, f.size] for f in sorted(found, key=lambda f: f.base_name)
                    if f.type == pfs.FileType.File and match(f.base_name, self.pattern)}

        def initialOffset(self) -> dict:
            return {"files": {}}

        def latestOffset(self) -> dict:
            return {"files": self._held()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            had = start["files"]
            return [Files([(f"{self.folder}/{n}", n, x[1], x[0]) for n, x in sorted(end["files"].items()) if had.get(n) != x])]

        def read(self, partition: Files):
            yield from partition.rows

    class Arrivals(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options["path"], self.options.get("pattern", "*"))

    return Arrivals


def arrivals(spark: SparkSession, folder: str):
    """The stream of a folder's monthly files (``yol``, ``ad``, ``bayt``, ``zaman_ns``).

    ``folder`` is a URI or an absolute path on a store that Arrow reads too
    (local, HDFS, S3, GCS).
    """
    spark.dataSource.register(_source())
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return spark.readStream.format(FORMAT).option("pattern", PATTERN).load(folder)
