"""Ranks, limits, samples and choices with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row written for each key."""
    return top_of_each(df, [key], [c.desc() for c in order])


def top_n(df: DataFrame, condition: Column, order: list[Column], n: int) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(n)


def sample_of_each(df: DataFrame, cls: str, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each class by a hash of the id: the same rows however the table is partitioned."""
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)).cast("binary"))
    return top_of_each(df.where(F.col(cls).isNotNull()), [cls], [key, F.col(id_col)], n)


def split_ids(ids: DataFrame, id_col: str, fraction: float, seed: str = "0") -> DataFrame:
    """ids with ``grp``: 'holdout' for round(fraction * n) of them in hash order, else 'train'; whole ids, so both are disjoint.

    The place in hash order is found in two steps (rows in each of 4096 ranges of the hash, then a rank inside the range), so
    that no task holds all ids.
    """
    keyed = ids.select(F.col(id_col)).distinct().withColumn("_k", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)).cast("binary")))
    keyed = keyed.withColumn("_range", F.substring("_k", 1, 3))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_range")
    sizes = sizes.select("_range", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_k", id_col))
    return keyed.join(sizes, "_range").select(id_col, F.when(place <= F.round(F.col("_all") * fraction), "holdout").otherwise("train").alias("grp"))


def freshest(layers: DataFrame) -> DataFrame:
    """The layer (name, at, seq) with the latest time; missing times take no part, the first of equals wins."""
    return layers.where("at is not null").orderBy(F.desc("at"), "seq").limit(1)


def dominant(df: DataFrame, day: str, group: list[str]) -> DataFrame:
    """For each day the group with the most rows, ties to the smallest group."""
    counted = df.groupBy(day, *group).agg(F.count("*").alias("n"))
    return top_of_each(counted, [day], [F.desc("n"), *map(F.col, group)])


def newest_where(df: DataFrame, condition: Column, day: str) -> DataFrame:
    """The newest row that meets a condition."""
    return df.where(condition).orderBy(F.desc(day)).limit(1)


def lead(df: DataFrame, allocation: str, passes: str, warrants: str, name: str) -> DataFrame:
    """The row to lead with: the largest allocation among those with an observed pass, else among those that warrant review."""
    return df.where((F.col(passes) > 0) | F.col(warrants)).orderBy((F.col(passes) > 0).desc(), F.col(allocation).desc(), F.col(name)).limit(1)


def first_distinct(df: DataFrame, name: str, order: str, n: int | None = None) -> DataFrame:
    """name, order: each name once, at its first place, in that order; the first ``n`` of them."""
    out = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias(order)).orderBy(order, name)
    return out if n is None else out.limit(n)


def bernoulli(df: DataFrame, id_col: str, fraction: float, seed: str = "0") -> DataFrame:
    """``df`` and grp: 'holdout' with probability ``fraction`` by a seeded hash of the id, else 'train'; no row depends on another."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn("grp", F.when(place < fraction, "holdout").otherwise("train"))
