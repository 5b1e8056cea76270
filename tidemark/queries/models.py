"""Scores and metrics (A16, A20, F55, F56, M1-M5) and the streaming accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import ranking, rollups
from tidemark.plans import recurrence
from tidemark.queries.base import query, table
from tidemark.sources.shared import cut

_WEIGHTS = [round(((i * 37) % 11 - 5) / 4, 2) for i in range(64)]
_SCORED = "WITH s AS (SELECT CAST(quality AS INTEGER) AS y, 1 / (1 + exp(-(n_chars - 2000) / 1500.0)) AS p FROM labels JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("quality").cast("int").alias("y"), scoring.sigmoid((F.col("n_chars") - 2000) / 1500.0).alias("p"))


@query(f"""{_SCORED}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5) AS pp, count(*) FILTER (WHERE y = 1) AS pos, avg(pow(p - y, 2)) AS b FROM s)
SELECT n, round(tp / pp, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * (tp / pp) * (tp / pos) / (tp / pp + tp / pos), 6) AS f1, round(b, 6) AS brier FROM c""")
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, Brier."""
    return rollups.binary_metrics(_scored(spark, sf_dir), F.col("y"), F.col("p"))


@query(f"""{_SCORED}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s),
a AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), w AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS pp FROM g)
SELECT round(auc, 6) AS auc, (SELECT round(sum(pos * tp / pp) / sum(pos), 6) FROM w) AS ap FROM a""")
def q_auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve by mid-ranks, average precision."""
    return rollups.ranked_metrics(_scored(spark, sf_dir), F.col("y"), F.col("p"))


@query(f"""
WITH s AS (SELECT vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_WEIGHTS!r} AS DOUBLE[])) AS raw FROM embeddings),
p AS (SELECT vec_id, label, round(raw, 6) AS raw, 1 / (1 + exp(-(1.11765 * raw + 0.56128))) AS p FROM s)
SELECT vec_id, raw, round(p, 4) AS score, round(p, 4) >= 0.5 AS prone FROM p
""")
def q_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear decision, sigmoid, rounded score and what follows from it."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", scoring.dot(F.col("embedding"), _WEIGHTS).alias("raw"))
    return recurrence.calibrated(s, 1.11765, 0.56128).select("vec_id", F.round("raw", 6).alias("raw"), "score", "prone")


@query(f"SELECT count(*) FILTER (WHERE 1 / (1 + exp(-list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_WEIGHTS!r} AS DOUBLE[])))) >= 0.6 AND label >= 3) AS n FROM embeddings")
def q_prone_unrecorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places called prone without a record."""
    s = table(spark, sf_dir, "embeddings").select((F.col("label") < 3).cast("int").alias("y"), scoring.sigmoid(scoring.dot(F.col("embedding"), _WEIGHTS)).alias("p"))
    return recurrence.prone_unrecorded(s)


@query()
def q_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3, M5: training on whole held-in groups, Platt scaling, held-out metrics; tested against a Newton solution."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"), (F.col("vec_id") % 60).alias("event"))
    grouped = s.join(ranking.split_ids(s, "event", 0.3, "42"), "event")
    train, hold = grouped.where("grp = 'train'"), grouped.where("grp = 'holdout'")
    scored = cut(recurrence.decision(recurrence.train(train), hold))
    a, b = recurrence.platt(scored)
    return recurrence.evaluate(recurrence.calibrated(scored, a, b))


@query("""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, sum(value) AS mm, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, start, round(mm, 4) AS mm, n FROM w
""")
def q_stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 as a stream: windowed sums of a file stream that ends, equal to the batch result."""
    from tidemark.streaming import accumulate

    return accumulate.run_once(spark, sf_dir, "6 hours", "6 hours").select("event_type", "start", F.round("mm", 4).alias("mm"), "n")
