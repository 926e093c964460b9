"""Map tables: boundary enrichment (C30) and outer rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityrhythm import dims
from cityrhythm.functions import normalize_name
from cityrhythm.sources.geojson import polygon_parts


def map_enrich(boundaries: DataFrame, index: DataFrame, value: str = "endeks") -> DataFrame:
    """Per boundary feature its normalised district name, the night index
    (NULL when the district has none) and the tooltip text ('‰x.x' or no rail).

    The index has one row per district (tens of rows); Catalyst broadcasts it.
    """
    b = boundaries.select("ad", normalize_name("ad").alias("ilce"))
    j = b.join(index.select("ilce", value), "ilce", "left")
    text = F.when(F.col(value).isNull(), F.lit(dims.NO_RAIL_TEXT)).otherwise(
        F.concat(F.lit(dims.PER_MILLE), F.format_string("%.1f", F.col(value))))
    return j.select("ad", "ilce", value, text.alias("gece_endeksi"))


def outer_rings(boundaries: DataFrame, alive: DataFrame) -> DataFrame:
    """One row per polygon part with its outer ring only; ``canli`` is true
    when the feature's district is in ``alive`` (e.g. the pulse districts)."""
    parts = polygon_parts(boundaries).select(
        "ad", normalize_name("ad").alias("ilce"), F.posexplode("parcalar").alias("parca", "poligon"))
    live = alive.select(F.col("ilce").alias("_a_ilce")).distinct()
    j = parts.join(live, F.col("ilce") == F.col("_a_ilce"), "left")
    return j.select("ad", "ilce", "parca", F.col("poligon")[0].alias("dis_halka"),
                    F.col("_a_ilce").isNotNull().alias("canli"))


def ring_points(rings: DataFrame) -> DataFrame:
    """C32 as points: one row per vertex of each outer ring (ad, ilce, parca,
    sira, x, y, canli) — the shape a map layer or a plotting step reads."""
    pts = rings.select("ad", "ilce", "parca", "canli", F.posexplode("dis_halka").alias("sira", "_p"))
    return pts.select("ad", "ilce", "parca", "sira", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), "canli")


def ring_texts(rings: DataFrame) -> DataFrame:
    """C32 with each outer ring as text: ad, ilce, parca, canli, nokta (vertices) and halka ("x y, x y", six decimals)."""
    vertex = F.transform("dis_halka", lambda p: F.format_string("%.6f %.6f", p[0], p[1]))
    return rings.select("ad", "ilce", "parca", "canli", F.size("dis_halka").alias("nokta"), F.array_join(vertex, ", ").alias("halka"))
