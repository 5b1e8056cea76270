"""Observed flood extent: threshold, change, masks, smoothing, components, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import raster, tiles

RAILS = (-24.0, -14.0)


def threshold(cells: DataFrame, rails: tuple[float, float] = RAILS) -> DataFrame:
    """threshold: Otsu's of band vh, held between the rails; one row, which is joined and not collected."""
    t = raster.otsu(raster.histogram(cells, F.col("vh")))
    return t.select(F.greatest(F.lit(rails[0]), F.least(F.lit(rails[1]), F.col("threshold"))).alias("threshold"))


def detect(cells: DataFrame, least_size: int = 12) -> DataFrame:
    """row, col, size of flooded cells of (row, col, vh, base_vh, perm, slope, plausible)."""
    smooth = tiles.focal(cells.select("row", "col", "vh"), raster.disc(1), ["median"], "vh").withColumnRenamed("median", "vh")
    ready = cells.drop("vh").join(smooth, ["row", "col"])
    one = F.broadcast(threshold(ready))  # a single row by construction
    return raster.flood_cells(ready.join(one, F.lit(True)), F.col("threshold"), least_size)


def area_km2(cells: DataFrame, cell_m2: float) -> DataFrame:
    return cells.agg((F.count("*") * cell_m2 / 1e6).alias("area_km2"))


def coverage(scene_cells: DataFrame, area_cells: DataFrame) -> DataFrame:
    """day, coverage: the share of the area's cells that a day's scenes hold."""
    total = area_cells.agg(F.count("*").alias("all"))
    return scene_cells.join(area_cells, ["row", "col"], "left_semi").groupBy("day").agg(F.countDistinct("row", "col").alias("n")).join(F.broadcast(total), F.lit(True)).select("day", (F.col("n") / F.greatest(F.lit(1), F.col("all"))).alias("coverage"))
