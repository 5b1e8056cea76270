"""The recurrence model: balanced logistic regression, Platt scaling, held-out metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import sigmoid
from tidemark.operators.rollups import binary_metrics, ranked_metrics


def _fit(df: DataFrame, penalty: float, weight: str | None) -> LogisticRegressionModel:
    lr = LogisticRegression(featuresCol="f", labelCol="y", regParam=penalty, standardization=False, tol=1e-10, maxIter=2000)
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def train(samples: DataFrame, c: float = 1.0) -> LogisticRegressionModel:
    """L2 logistic regression of (embedding, y), classes weighted to equal shares; ``c`` is the inverse penalty."""
    n = {r["y"]: r["n"] for r in samples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(0.0)
    for y, k in n.items():
        weight = F.when(F.col("y") == y, total / (len(n) * k)).otherwise(weight)
    df = samples.select(F.col("y").cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("f"), weight.alias("w"))
    return _fit(df, 1.0 / (c * total), "w")


def decision(model: LogisticRegressionModel, samples: DataFrame) -> DataFrame:
    """``samples`` and raw: the linear decision value."""
    df = model.setFeaturesCol("_f").transform(samples.withColumn("_f", array_to_vector(F.col("embedding").cast("array<double>"))))
    return df.withColumn("raw", vector_to_array("rawPrediction")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def platt(scored: DataFrame, c: float = 1e6) -> tuple[float, float]:
    """A, B of the logistic fit to (raw, y), all but unpenalised."""
    n = scored.count()
    model = _fit(scored.select(F.col("y").cast("double").alias("y"), array_to_vector(F.array(F.col("raw"))).alias("f")), 1.0 / (c * n), None)
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(scored: DataFrame, a: float, b: float) -> DataFrame:
    """``scored`` with p, score (rounded) and prone (of the rounded score)."""
    return scored.withColumn("p", sigmoid(F.lit(a) * F.col("raw") + F.lit(b))).withColumn("score", F.round("p", 4)).withColumn("prone", F.col("score") >= 0.5)


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: n, precision, recall, f1, brier, auc, ap of (y, p)."""
    return binary_metrics(scored, F.col("y"), F.col("p")).join(F.broadcast(ranked_metrics(scored, F.col("y"), F.col("p"))), F.lit(True))


def prone_unrecorded(scored: DataFrame, least: float = 0.6) -> DataFrame:
    """n: places that the model calls prone (unrounded) and no event has recorded."""
    return scored.agg(F.sum(F.when((F.col("p") >= least) & (F.col("y") == 0), 1).otherwise(0)).cast("long").alias("n"))
