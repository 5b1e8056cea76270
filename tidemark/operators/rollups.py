"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores in the first step of a rank over all rows.
RANGES = 256


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0.0))


def by_dimension(df: DataFrame, key: str, members: Sequence[str], aggregates: Sequence[Column], zeros: Sequence[str]) -> DataFrame:
    """Aggregates for every member of a fixed dimension in its order, zero where no row has it."""
    spark = df.sparkSession
    dimension = spark.range(1).select(F.posexplode(F.array(*map(F.lit, members))).alias("ordinal", key))
    summed = df.groupBy(key).agg(*aggregates)
    joined = dimension.join(summed, key, "left")
    return joined.select("ordinal", key, *[F.coalesce(c, F.lit(0)).alias(c) if c in zeros else F.col(c) for c in summed.columns if c != key])


def pivot_counts(df: DataFrame, key: str, kind: str, kinds: Sequence[str], aggregates: Sequence[Column] = ()) -> DataFrame:
    """A count of each kind as a column, and further aggregates; one pass, one shuffle."""
    return df.groupBy(key).agg(*[count_where(F.col(kind) == k).alias(k) for k in kinds], *aggregates)


def histogram_of(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def sorted_set(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def binary_metrics(df: DataFrame, y: Column, p: Column, cut: float = 0.5) -> DataFrame:
    """n, precision, recall, f1, brier of labels and probabilities."""
    s = df.select(y.cast("int").alias("y"), p.alias("p")).agg(
        F.count("*").alias("n"), count_where((F.col("p") >= cut) & (F.col("y") == 1)).alias("tp"), count_where(F.col("p") >= cut).alias("pp"), count_where(F.col("y") == 1).alias("pos"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("b"),
    )
    pr, rc = F.try_divide("tp", "pp"), F.try_divide("tp", "pos")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return s.select("n", z(pr).alias("precision"), z(rc).alias("recall"), z(F.try_divide(2 * pr * rc, pr + rc)).alias("f1"), F.round("b", 6).alias("brier"))


def ranked_metrics(df: DataFrame, y: Column, score: Column) -> DataFrame:
    """auc, ap: area under the ROC curve by mid-ranks, and average precision over distinct thresholds.

    Rows are summed for each distinct score first. The running sums are made in two steps, over at most ``RANGES`` ranges of scores and
    then inside each range, so that no task holds all scores.
    """
    g = df.select(y.cast("int").alias("y"), score.alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    cuts = g.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("cuts"))  # one row
    g = g.join(F.broadcast(cuts), F.lit(True)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    sums = g.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"))
    down = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = g.join(before, "range").select("pos", "n", (F.col("bp") + F.sum("pos").over(down)).alias("tp"), (F.col("bn") + F.sum("n").over(down)).alias("pp"))
    total = run.agg(
        F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"),
        # for each score: its positives beat all negatives below, and half of those beside
        F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") + F.col("pos") / 2)).alias("u"),
        F.sum(F.col("pos") * F.col("tp") / F.col("pp")).alias("ap"),
    )
    return total.select(F.round(F.try_divide(F.col("u"), F.col("p") * F.col("q")), 6).alias("auc"), F.round(F.try_divide("ap", "p"), 6).alias("ap"))
