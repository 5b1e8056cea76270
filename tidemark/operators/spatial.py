"""Spatial joins as equi-joins on tiles, with even-odd parity instead of a geometry library."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_KM, corridor_steps, haversine_km
from tidemark.sources.shared import cut


def edges(polygons: DataFrame, key: str = "poly_id", rings: str = "rings", also: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``also`` of the polygon, x1, y1, x2, y2: the edges of all rings (array<array<struct<x,y>>>); open rings are closed.

    Degenerate rings (fewer than three points) are dropped; holes and several parts need no care under even-odd parity.
    """
    own = [key, *also]
    ring = polygons.select(*own, F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    following = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    pair = ring.select(*own, F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))
    return pair.select(*own, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def inside(points: DataFrame, edge: DataFrame, id_col: str, x: str, y: str, key: str = "poly_id", tile: float = 1.0) -> DataFrame:
    """id_col, key of all (point, polygon) with the point inside.

    Points meet the polygons whose boxes reach into their tile, then the edges of such a polygon in their row of tiles, which a
    ray to the right may cross. Both are equi-joins, on (tile column, tile row) and on (polygon, row), so no key stands for a
    whole row of the map. A point on the boundary belongs to one side as in half-open ray casting. Points with NULL coordinates
    are in nothing.
    """
    at_tile = lambda c: F.floor(c / F.lit(tile)).cast("long")
    row = lambda low, high: F.explode(F.sequence(at_tile(low), at_tile(high)))
    spread = edge.where("y1 <> y2").select(key, "x1", "y1", "x2", "y2", row(F.least("y1", "y2"), F.greatest("y1", "y2")).alias("_row"))
    box = edge.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("_left"), F.max(F.greatest("x1", "x2")).alias("_right"), F.min(F.least("y1", "y2")).alias("_low"), F.max(F.greatest("y1", "y2")).alias("_high"))
    tiles = box.select(key, "_left", "_right", row(F.col("_left"), F.col("_right")).alias("_col"), "_low", "_high").withColumn("_row", row(F.col("_low"), F.col("_high")))
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = known.select(id_col, F.col(x).alias("_px"), F.col(y).alias("_py"), at_tile(F.col(x)).alias("_col"), at_tile(F.col(y)).alias("_row"))
    near = at.join(tiles, ["_col", "_row"]).where("_px between _left and _right and _py between _low and _high")
    crossing = ((F.col("y1") > F.col("_py")) != (F.col("y2") > F.col("_py"))) & (F.col("_px") < (F.col("x2") - F.col("x1")) * (F.col("_py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = near.select(id_col, key, "_px", "_py", "_row").join(spread, [key, "_row"]).where(crossing)
    return hits.groupBy(id_col, key).agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1).select(id_col, key)


def first_inside(points: DataFrame, edge: DataFrame, id_col: str, x: str, y: str, key: str = "poly_id", tile: float = 1.0) -> DataFrame:
    """id_col, key: the first polygon (smallest key) that holds a point."""
    return inside(points, edge, id_col, x, y, key, tile).groupBy(id_col).agg(F.min(key).alias(key))


def _rows_and_columns(lat: Column, lon: Column, km: float, row: Column | None = None) -> tuple[Column, Column, Column]:
    """Row, column and number of columns of the cell of a place; cells are at least ``km`` high and, all around the row and its neighbours, wide."""
    height = km / 111.0
    row = F.floor(lat / F.lit(height)).cast("long") if row is None else row
    # two places in neighbouring rows, at most ``km`` apart, differ by no more than this in longitude
    far = F.least(F.lit(90.0), F.greatest(F.abs(row), F.abs(row + 1)) * height + height)
    part = F.lit(math.sin(min(km / (2 * EARTH_KM), math.pi / 2))) / F.cos(F.radians(far))
    columns = F.when((part < 1) & (far < 90), F.greatest(F.lit(1), F.floor(F.lit(math.pi) / F.asin(F.least(F.lit(1.0), part))))).otherwise(1).cast("long")
    return row, F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / (F.lit(360.0) / columns)).cast("long"), columns), columns


def _candidates(points: DataFrame, sites: DataFrame, km: float, how: str = "inner") -> DataFrame:
    """points and the other columns of sites with _row, _col, km: at least all sites within ``km``, those that reach into the cell of a point.

    Each site (lat, lon) stands in its own cell and in those around it, across the date line too, and each point (lat, lon) in its own only: what
    is grouped by cell and point needs no other shuffle than that of the points.
    """
    own, near = F.floor(F.col("s_lat") / F.lit(km / 111.0)).cast("long"), F.array(*map(F.lit, (-1, 0, 1)))
    rows = sites.withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"}).withColumn("_row", F.explode(F.transform(near, lambda i: own + i)))
    _, column, columns = _rows_and_columns(F.col("s_lat"), F.col("s_lon"), km, F.col("_row"))
    place = rows.withColumn("_col", F.explode(F.array_distinct(F.transform(near, lambda i: F.pmod(column + i, columns)))))
    row, column, _ = _rows_and_columns(F.col("lat"), F.col("lon"), km)
    found = points.select("*", row.alias("_row"), column.alias("_col")).join(place, ["_row", "_col"], how)
    return found.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")))


def dense_cell(sites: DataFrame, cell: float, most: int, least: float = 1e-4) -> float:
    """``cell`` halved until none of its cells holds more than ``most`` of the places of ``sites`` (lat, lon), or it is ``least`` degrees wide.

    All sizes are counted in one pass: a row for each size and cell, of which only the largest count of each size reaches the driver.
    """
    widths = [cell]
    while widths[-1] / 2 >= least:
        widths.append(widths[-1] / 2)
    at = lambda c: F.floor(F.col(c) / F.col("w")).cast("long")
    cells = sites.select("lat", "lon", F.explode(F.array(*map(F.lit, widths))).alias("w")).groupBy("w", at("lat").alias("r"), at("lon").alias("c")).agg(F.count("*").alias("n"))
    fits = [r["w"] for r in cells.groupBy("w").agg(F.max("n").alias("n")).where(F.col("n") <= most).collect()]
    return max(fits, default=widths[-1])


#: Distances of sites are equal if they are so to a millimetre.
SAME_KM = 1e-6


def nearest(points: DataFrame, sites: DataFrame, cell: float = 1.0, most: int = 16) -> DataFrame:
    """id, site_id, km for points (id, lat, lon) and sites (site_id, lat, lon): the nearest in whole millimetres, ties to the smaller site_id.

    Points look at the sites of their own cell and those around, in cells of ``cell`` degrees at first, or of as much less as leaves no
    cell with more than ``most`` sites (dense_cell). What has none within the cells' size looks again in cells twice as large. A point
    comes to cells as large as the globe only if no site is within a quarter of the way around it. Sites at one place are one
    site with the smallest id, and points at one place are looked up once, so that no place is a hot key. Points without
    coordinates, and all points if there are no sites, have no row.
    """
    sites = cut(sites.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("site_id").alias("site_id")))
    asked = points.select("id", "lat", "lon").where("lat is not null and lon is not null")
    points, settled = asked.select("lat", "lon").distinct(), None
    km = dense_cell(sites, cell, most) * 111.0
    while True:
        found = _candidates(points, sites, km, "left").withColumn("mm", F.floor(F.col("km") / SAME_KM + 0.5))
        best = cut(found.groupBy("_row", "_col", "lat", "lon").agg(F.min(F.when(F.col("site_id").isNotNull(), F.struct("mm", "site_id", "km"))).alias("b")))
        last = km > math.pi * EARTH_KM
        sure = F.col("b").isNotNull() if last else F.coalesce(F.col("b.km") <= km - 2 * SAME_KM, F.lit(False))
        done = best.where(sure).select("lat", "lon", F.col("b.site_id").alias("site_id"), F.col("b.km").alias("km"))
        settled = done if settled is None else settled.unionByName(done)
        points = best.where(~sure).select("lat", "lon")
        if last or points.isEmpty():
            return asked.join(settled, ["lat", "lon"]).select("id", "site_id", "km")
        km *= 2


def _at_places(df: DataFrame, key: str, many: str, most: int = 1024) -> DataFrame:
    """lat, lon and arrays ``many`` of the keys that stand there, some ``most`` to an array at the utmost."""
    known = df.select("lat", "lon", key).where("lat is not null and lon is not null")
    parts = known.groupBy("lat", "lon").agg(F.ceil(F.count("*") / most).alias("_parts"))
    crowded = parts.where("_parts > 1")
    dealt = known.join(crowded, ["lat", "lon"], "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))))
    return dealt.groupBy("lat", "lon", "_part").agg(F.collect_list(key).alias(many)).drop("_part")


def within_km(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """id, site_id, km of all pairs at most ``km`` apart: an equi-join on cells of that size, then the distance.

    Places meet, once however many points and sites stand there; a pair's row is made of theirs at the end.
    """
    met = _candidates(_at_places(points, "id", "_ids"), _at_places(sites, "site_id", "_sites"), km).where(F.col("km") <= km)
    return met.select("_ids", F.explode("_sites").alias("site_id"), "km").select(F.explode("_ids").alias("id"), "site_id", "km")


def nearest_ring(points: DataFrame, polygons: DataFrame, key: str = "poly_id", rings: str = "rings", cell: float = 1.0) -> DataFrame:
    """id, key, km: the polygon with the ring whose vertices' mean is nearest to a point (id, lat, lon)."""
    centres = ring_centroids(polygons, key, rings).select(F.struct(key, "ring").alias("site_id"), "lat", "lon")
    return nearest(points, centres, cell).select("id", F.col(f"site_id.{key}").alias(key), "km")


def corridor_points(lines: DataFrame, step_m: float = 350.0) -> DataFrame:
    """id, i, lon, lat: evenly spaced points of lines (id, lon1, lat1, lon2, lat2)."""
    ends = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    stepped = lines.select("id", *ends, corridor_steps(*ends, step_m).alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / F.col("n"))
    return stepped.select("id", "i", at("lon1", "lon2").alias("lon"), at("lat1", "lat2").alias("lat"))


def best_along(samples: DataFrame, compatible: bool = False) -> DataFrame:
    """id, score, km from samples (id, i, score, km): the largest score and the smallest distance.

    ``compatible``: fold in order of i, where a nearer sample resets a higher score.
    """
    if not compatible:
        return samples.groupBy("id").agg(F.max("score").alias("score"), F.min("km").alias("km"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "score", "km")))
    start = F.struct(F.lit(-1.0).alias("score"), F.lit(float("inf")).alias("km"))

    def step(s: Column, x: Column) -> Column:
        nearer = x["km"] < s["km"]
        score = F.when(nearer, x["score"]).otherwise(F.greatest(s["score"], x["score"]))
        return F.struct(score.alias("score"), F.least(s["km"], x["km"]).alias("km"))

    return samples.groupBy("id").agg(F.aggregate(ordered, start, step).alias("b")).select("id", "b.score", "b.km")


def ring_centroids(polygons: DataFrame, key: str = "poly_id", rings: str = "rings") -> DataFrame:
    """key, ring, lon, lat: the mean of each ring's vertices."""
    return (
        polygons.select(key, F.posexplode(rings).alias("ring", "points"))
        .select(key, "ring", F.explode("points").alias("p"))
        .groupBy(key, "ring")
        .agg(F.avg("p.x").alias("lon"), F.avg("p.y").alias("lat"))
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
