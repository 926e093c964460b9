"""Station -> district lookup for line M7 (a small CSV code table: istasyon, ilce)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityrhythm import dims, schema


def lookup_df(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LOOKUP_SCHEMA).option("header", True).csv(path)


def builtin_lookup(spark: SparkSession) -> DataFrame:
    """The M7 station table shipped with the engine (``dims.M7_STATION_DISTRICT``)."""
    return spark.createDataFrame(list(dims.M7_STATION_DISTRICT.items()), schema.LOOKUP_SCHEMA)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The lookup as a relation to be joined, whatever its size. Rows without a
    station match nothing and are left out; a repeated station would multiply
    trip rows in the join and is rejected."""
    df = lookup_df(spark, path).where(F.col("istasyon").isNotNull())
    dup = df.groupBy("istasyon").count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"lookup key not unique: {dup[0]['istasyon']!r}")
    return df
