"""District boundaries: GeoJSON FeatureCollections.

A file is cut where its features begin, so that several tasks read a large one.
``coordinates`` nests differently per geometry type (Polygon: rings;
MultiPolygon: parts of rings), so it is read as its raw JSON text and parsed
with ``from_json`` once the type is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),   # raw JSON text
    ])),
])
FEATURE_COLLECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(FEATURE))])
BROKEN = "_bozuk"
#: What stands before the word that cuts a file, and after it.
OPENS, GOES_ON = r'\{\s*"type"\s*:\s*$', r"^\s*[,}]"

RING = "array<array<double>>"
POLYGON = f"array<{RING}>"
MULTIPOLYGON = f"array<{POLYGON}>"


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: (ad, geometri, koordinat) — name, geometry type, raw coordinates.

    Files are read in splits and cut at the word "Feature", with which the
    first member of every feature ends (``{"type": "Feature"``). Files whose
    features begin otherwise, or that have the word elsewhere (in a property,
    say), are found by one job beforehand and read whole, a task each. A
    collection without features has no row.
    """
    cut = _pieces(spark, path)
    last = F.sum((~F.col("piece").rlike(OPENS)).cast("int"))
    torn = F.max(F.col("f").isNull() | F.col(f"f.{BROKEN}").isNotNull())
    odd = cut.groupBy("path").agg(last.alias("last"), torn.alias("torn")).where("last <> 1 OR torn").select("path")
    whole = [r.path for r in odd.collect()]
    out = _named(cut.where(F.col("path").isin(whole).eqNullSafe(False)) if whole else cut)
    if whole:
        out = out.unionByName(_features(spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(whole)))
    return out


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, piece (what follows the word up to its next one), f (the feature read from it).

    The piece before a file's first feature has a feature without members.
    """
    schema = T.StructType([*FEATURE.fields, T.StructField(BROKEN, T.StringType())])
    text = F.concat(F.when(F.col("piece").rlike(GOES_ON), F.lit('{"type": "Feature"')).otherwise(F.lit("{}")), "piece")
    return (spark.read.option("lineSep", '"Feature"').text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("piece"))
            .withColumn("f", F.from_json(text, schema, {"columnNameOfCorruptRecord": BROKEN})))


def _named(features: DataFrame) -> DataFrame:
    return (features.where("f.type is not null")
            .select(F.col("f.properties.name").alias("ad"), F.col("f.geometry.type").alias("geometri"),
                    F.col("f.geometry.coordinates").alias("koordinat")))


def boundaries_of(spark: SparkSession, text: str) -> DataFrame:
    """The same from a GeoJSON text that the driver has."""
    fc = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", FEATURE_COLLECTION).alias("c")).select("c.*")
    return _features(fc)


def _features(fc: DataFrame) -> DataFrame:
    return _named(fc.select(F.explode("features").alias("f")))


def polygon_parts(boundaries: DataFrame) -> DataFrame:
    """Each feature as an array of polygons (a Polygon is one part)."""
    poly = F.from_json(F.col("koordinat"), POLYGON)
    multi = F.from_json(F.col("koordinat"), MULTIPOLYGON)
    parts = F.when(F.col("geometri") == "Polygon", F.array(poly)).otherwise(multi)
    return boundaries.select("ad", "geometri", parts.alias("parcalar"))
