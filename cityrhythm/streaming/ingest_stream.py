"""Incremental ingest as a stream of arriving files (A10, alternative form).

The stream carries arrivals (:mod:`file_events`), not rows: each micro-batch
names the files that are new or have changed since the last one, and
``foreachBatch`` hands them to the batch ingest, which parses, gates and
publishes them. So both forms decide alike, a header without rows is reported,
and a rejected month that is downloaded again under its name is taken without
a batch run. A file that is still being written comes again when it has grown.

The checkpoint lives in the shared folder named by ``spark.checkpoint.dir``. A
micro-batch that is retried after a failure finds the months it had published
and skips them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cityrhythm import dims
from cityrhythm.operators.ingest import ingest_files
from cityrhythm.session import work_path
from cityrhythm.sources import raw_csv
from cityrhythm.streaming.file_events import arrivals


def start(spark: SparkSession, raw_dir: str, clean_path: str, log_path: str,
          min_rows: int = dims.MIN_ROWS_PER_DAY, checkpoint: str | None = None,
          files_per_batch: int | None = None):
    """Start the availableNow stream; returns the StreamingQuery (call ``awaitTermination()``).

    Decisions are those of :func:`cityrhythm.operators.ingest.ingest`, and are
    appended to the same log. ``files_per_batch`` bounds how many files are
    parsed into one staging table; a backlog is then worked off in steps.
    """
    checkpoint = checkpoint or work_path(spark, "streams/ingest")

    def handle(batch: DataFrame, epoch: int) -> None:
        files = sorted(r["yol"] for r in batch.select("yol").collect() if raw_csv.month_of(r["yol"]))   # one row a monthly file
        step = files_per_batch or max(len(files), 1)
        for a in range(0, len(files), step):
            ingest_files(batch.sparkSession, files[a:a + step], clean_path, log_path, min_rows)

    return (arrivals(spark, raw_dir).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
