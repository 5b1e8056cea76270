"""Roads against an observed extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bands, geo
from tidemark.operators import rollups, vector

#: Metres by which a published line may differ from the road: where it is wet or near, and elsewhere.
FINE_M, COARSE_M = 12.0, 110.0


def exposure(roads: DataFrame, water: DataFrame, usable: bool, buffer_m: float = 30.0, tile: float = 1000.0) -> DataFrame:
    """osm_id, road_name, corridor, is_expressway, length_m, flooded_m, near_m, fraction, exposure.

    near_m is the length in the water or at most ``buffer_m`` from it.

    roads: osm_id, highway, ref, name, coords (array<struct<x,y>>, degrees); water: edges of polygons (poly_id, x1, y1, x2, y2, metres).
    """
    named = roads.withColumn("c", bands.corridor_of(F.col("ref"), F.col("name"))).where(bands.road_in_scope(F.col("highway"), F.col("ref"), F.col("c.is_expressway")))
    found = vector.lengths(vector.utm_segments(named, "osm_id", "coords"), water, "osm_id", buffer_m, tile=tile, whole="length_m")
    # both sides are as long as the table; of compressed files Spark thinks that they are small enough to be broadcast
    j = named.hint("merge").join(found, "osm_id")
    flooded, close = (F.col(c) if usable else F.lit(0.0) for c in ("inside_len", "near_len"))
    return j.select(
        "osm_id", "c.road_name", "c.corridor", "c.is_expressway", F.round("length_m", 1).alias("length_m"), F.round(flooded, 1).alias("flooded_m"), F.round(close, 1).alias("near_m"), F.round(flooded / F.col("length_m"), 4).alias("fraction"),
        bands.exposure_class(F.lit(usable), F.col("length_m"), flooded, close).alias("exposure"),
    )


def corridor_summary(exposed: DataFrame) -> DataFrame:
    """corridor, flooded, near, clear, unknown, flooded_km."""
    kinds = ["flooded", "near", "clear", "unknown"]
    return rollups.pivot_counts(exposed.where("corridor <> ''"), "corridor", "exposure", kinds, [F.round(F.sum("flooded_m") / 1000, 3).alias("flooded_km")])


def published(roads: DataFrame, exposed: DataFrame, digits: int = 5) -> DataFrame:
    """``exposed`` with geometry: each road (osm_id, coords in degrees) simplified in metres, finely where it is flooded or near, and rounded degrees.

    Roads without coordinates, or with fewer than two, keep what they have.
    """
    # as long as the table on both sides, so no broadcast by the size of compressed files
    both = exposed.hint("merge").join(roads.select("osm_id", F.col("coords").alias("_c")), "osm_id", "left")
    tolerance = F.when(F.col("exposure").isin("flooded", "near"), FINE_M).otherwise(COARSE_M)
    return both.withColumn("geometry", geo.rounded(vector.utm_simplify("_c", tolerance), digits)).drop("_c")
