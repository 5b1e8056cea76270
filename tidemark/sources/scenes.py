"""Scene collections, static layers and event images as tables of cells.

A collection is one row for each scene (scene_id, day, mode, pols, west, south, east, north and what else it has) and one for each
of its cells (scene_id, row, col and bands), partitioned by day when written with ``write_cells``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.layers import missing


def in_window(day: Column, begin: str, end: str) -> Column:
    """Dates from ``begin`` up to, not including, ``end``."""
    return (day >= F.lit(begin).cast("date")) & (day < F.lit(end).cast("date"))


def scenes(collection: DataFrame, box: tuple[float, float, float, float], begin: str, end: str, mode: str | None = None, polarisation: str | None = None) -> DataFrame:
    """Scenes that touch ``box`` (west, south, east, north), of a window of dates, an instrument mode and with a polarisation."""
    west, south, east, north = box
    out = collection.where(in_window(F.col("day"), begin, end)).where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    out = out if mode is None else out.where(F.col("mode") == mode)
    return out if polarisation is None else out.where(F.array_contains("pols", polarisation))


def scene_cells(cells: DataFrame, chosen: DataFrame, bands: Sequence[str]) -> DataFrame:
    """scene_id, day, row, col and ``bands`` of the cells of chosen scenes; days and bands reach the scan."""
    return cells.select("scene_id", "day", "row", "col", *bands).join(chosen.select("scene_id", "day"), ["scene_id", "day"], "left_semi")


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells partitioned by day, so that a window of dates reads its own folders only."""
    cells.repartition("day").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("day").parquet(path)


def acquisition_dates(chosen: DataFrame) -> DataFrame:
    """day: the distinct dates of scenes, in order."""
    return chosen.select("day").distinct().orderBy("day")


def static_layers(spark: SparkSession, paths: Mapping[str, str], value: str = "value") -> DataFrame:
    """row, col and a column for each named layer; a cell that a layer lacks is NULL there. A missing layer is NULL everywhere."""
    parts = []
    for name, path in paths.items():
        if missing(spark, path):
            parts.append(spark.createDataFrame([], f"row long, col long, {name} double"))
        else:
            parts.append(spark.read.parquet(path).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias(name)))
    return reduce(lambda a, b: a.join(b, ["row", "col"], "full_outer"), parts)


def event_images(events: DataFrame, cells: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """event_id, began (UTC date), properties, row, col, flooded of past events whose image touches ``box``, oldest first inside an event's cells.

    events: event_id, started_ms, west, south, east, north and properties (map); cells: event_id, row, col, flooded.
    """
    west, south, east, north = box
    near = events.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    began = F.to_date(F.timestamp_millis("started_ms"))
    return near.select("event_id", began.alias("began"), "properties").join(cells, "event_id")


def label_masks(images: DataFrame, land: DataFrame, split: DataFrame) -> DataFrame:
    """row, col, mask of the land: 'train' or 'holdout' where only events of that group flooded the cell, 'never' where none did; cells of both groups are left out.

    images: event_id, row, col, flooded; land: row, col; split: event_id, grp. Events without a group count for 'never' only.
    """
    wet = images.where("flooded > 0").join(split, "event_id", "left").groupBy("row", "col")
    seen = wet.agg(F.coalesce(F.max(F.col("grp") == "train"), F.lit(False)).alias("t"), F.coalesce(F.max(F.col("grp") == "holdout"), F.lit(False)).alias("h"))
    of_group = F.when(F.col("t") & ~F.col("h"), "train").when(F.col("h") & ~F.col("t"), "holdout")
    mask = F.when(F.col("t").isNull(), "never").otherwise(of_group)
    return land.select("row", "col").distinct().join(seen, ["row", "col"], "left").select("row", "col", mask.alias("mask")).where("mask is not null")


def in_country(units: DataFrame, country: str, name: str = "ADM0_NAME") -> DataFrame:
    """Administrative units of one country."""
    return units.where(F.col(name) == country)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there, or if ``refresh`` asks for it. An empty result is never written.

    The new table is written beside the old one and takes its place when it is whole, so that ``make`` may read what it replaces.
    """
    if refresh or missing(spark, path):
        beside = f"{path.rstrip('/')}.new"
        make().write.mode("overwrite").parquet(beside)
        old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        if spark.read.parquet(beside).isEmpty():
            fs.delete(new, True)
            raise ValueError(f"nothing to write to {path}")
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{beside} can't be renamed to {path}")
    return spark.read.parquet(path)


def view(spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """The temporary view ``name``; loaded once in a session."""
    if not spark.catalog.tableExists(name):
        load().createOrReplaceTempView(name)
    return spark.table(name)
