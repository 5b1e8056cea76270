"""Rainfall accumulations and their layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bands import rain_band


def accumulate(rain: DataFrame, keys: list[str], end: Column, hours: tuple[int, int] = (24, 72), step_h: float = 0.5, inclusive: bool = False) -> DataFrame:
    """keys, mm_24h, mm_72h, n_24h, n_72h, flag of half-hour rates (ts, mm_per_hr) up to ``end``.

    Windows are (end - h, end]; ``inclusive`` takes the slice at the beginning too. Missing rates count as zero. The longer window is a
    filter on ts that reaches the scan.
    """
    short, long = (F.make_dt_interval(F.lit(0), F.lit(h)) for h in hours)
    after = lambda span: (F.col("ts") >= end - span) if inclusive else (F.col("ts") > end - span)
    recent = after(short)
    mm = F.coalesce("mm_per_hr", F.lit(0.0)) * step_h
    summed = rain.where(after(long) & (F.col("ts") <= end)).groupBy(*keys).agg(
        F.round(F.sum(F.when(recent, mm).otherwise(0.0)), 4).alias(f"mm_{hours[0]}h"), F.round(F.sum(mm), 4).alias(f"mm_{hours[1]}h"),
        F.sum(F.when(recent, 1).otherwise(0)).cast("long").alias(f"n_{hours[0]}h"), F.count("*").alias(f"n_{hours[1]}h"),
    )
    return summed.withColumn("flag", rain_band(F.col(f"mm_{hours[0]}h")))


def rolling(rain: DataFrame, keys: list[str], value: str, hours: int = 24) -> DataFrame:
    """``rain`` and mm: the sum of ``value`` over the trailing hours of each row."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-hours * 3600, 0)
    return rain.withColumn("mm", F.sum(value).over(w))


def layer_status(accumulated: DataFrame, slices: tuple[int, int] = (24, 72)) -> DataFrame:
    """scan_status, feature_count: no_data without rain slices, low_confidence where a window is sparse, else ok."""
    a = accumulated.agg(F.max("n_24h").alias("a"), F.max("n_72h").alias("b"), F.count("*").alias("n"))
    status = F.when(F.coalesce("b", F.lit(0)) == 0, "no_data").when((F.coalesce("a", F.lit(0)) < slices[0]) | (F.col("b") < slices[1]), "low_confidence").otherwise("ok")
    return a.select(status.alias("scan_status"), F.when(status == "no_data", 0).otherwise(F.col("n")).alias("feature_count"))
