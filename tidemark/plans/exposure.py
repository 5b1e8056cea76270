"""What units hold of cells and points, and their area under observed floods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spatial import inside


def polygon_cells(edge: DataFrame, size: float, key: str = "poly_id", tile: float | None = None) -> DataFrame:
    """key, row, col of the cells (``size`` wide, counted from zero) whose centre is in a polygon."""
    low = lambda c: F.floor(F.min(c) / size).cast("long")
    high = lambda c: F.floor(F.max(c) / size).cast("long")
    boxes = edge.groupBy(key).agg(low(F.least("x1", "x2")).alias("w"), high(F.greatest("x1", "x2")).alias("e"), low(F.least("y1", "y2")).alias("s"), high(F.greatest("y1", "y2")).alias("n"))
    centres = boxes.select(key, F.explode(F.sequence("s", "n")).alias("row"), "w", "e").select(key, "row", F.explode(F.sequence("w", "e")).alias("col"))
    own = centres.select("row", "col").distinct().select(F.struct("row", "col").alias("cell"), ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"))
    return inside(own, edge, "cell", "x", "y", key, tile or 16 * size).select(key, "cell.row", "cell.col")


def overlap(units: DataFrame, floods: DataFrame, cell_area: float, unit: str = "unit", day: str = "day") -> DataFrame:
    """unit, day, area, share of each unit that a day's flood covers, from cells (unit, row, col) and (day, row, col)."""
    own = units.select(unit, "row", "col").distinct()
    whole = own.groupBy(unit).agg(F.count("*").alias("cells"))
    wet = own.join(floods.select(day, "row", "col").distinct(), ["row", "col"]).groupBy(unit, day).agg(F.count("*").alias("wet"))
    return wet.join(whole, unit).select(unit, day, (F.col("wet") * cell_area).alias("area"), (F.col("wet") / F.col("cells")).alias("share"))


def peak(units: DataFrame, overlaps: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, peak: the largest share of any day, 0 for units that were never covered."""
    most = overlaps.groupBy(unit).agg(F.max("share").alias("peak"))
    return units.select(unit).distinct().join(most, unit, "left").select(unit, F.coalesce("peak", F.lit(0.0)).alias("peak"))


def zonal(cells: DataFrame, edge: DataFrame, size: float, aggregates: list[Column], key: str = "poly_id", tile: float | None = None) -> DataFrame:
    """key and ``aggregates`` over the cells (row, col, other columns; ``size`` wide, counted from zero) whose centres are in each polygon.

    Overlapping polygons count a cell each; polygons without a cell have no row; rows of one cell count as often as they are there.
    """
    centre = lambda c: (F.col(c) + 0.5) * size
    places = cells.select("row", "col").distinct().select(F.struct("row", "col").alias("cell"), centre("col").alias("x"), centre("row").alias("y"))
    member = inside(places, edge, "cell", "x", "y", key, tile or 16 * size).select(key, "cell.row", "cell.col")
    return cells.join(member, ["row", "col"]).groupBy(key).agg(*aggregates)


def unit_means(points: DataFrame, edge: DataFrame, units: DataFrame, value: str, key: str = "poly_id", tile: float = 1.0) -> DataFrame:
    """key, n, mean of ``value`` over the points (id, x, y) in each of ``units``; 0 where there is none."""
    held = points.join(inside(points, edge, "id", "x", "y", key, tile), "id").groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return units.select(key).distinct().join(held, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def affected(units: DataFrame, threshold: str, population: str, share: str) -> DataFrame:
    """mean_threshold, affected: the mean of the thresholds, and the people of the units that a flood covered in part (share > 0)."""
    return units.agg(F.avg(threshold).alias("mean_threshold"), F.coalesce(F.sum(F.when(F.col(share) > 0, F.col(population))), F.lit(0)).alias("affected"))
