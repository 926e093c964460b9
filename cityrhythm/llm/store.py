"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables.

    ``spark.checkpoint.dir`` names the shared folder and is only read. Where it
    is unset a local session uses the machine's temporary folder; any other
    session is refused, as its executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "cityrhythm-work")
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the work folder and read it back.

    Cuts the lineage: what follows survives lost executors without repeating
    the Python work before it, and sees the same rows however often it reads.
    The tables stay until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
