"""Rainfall accumulation as a structured stream: watermark, sliding windows, duplicates dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.layers import missing
from tidemark.sources.shared import shared_folder


def windows(rain: DataFrame, length: str, slide: str, lateness: str = "1 hour") -> DataFrame:
    """event_type, start, mm, n of a stream (event_id, ts, event_type, value); later rows than ``lateness`` are dropped once a window is closed."""
    timed = rain.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    unique = timed.dropDuplicates(["event_id", "at"])
    return unique.groupBy(F.window("at", length, slide).alias("w"), "event_type").agg(F.sum("value").alias("mm"), F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "mm", "n")


def run_once(spark: SparkSession, sf_dir: str, length: str, slide: str) -> DataFrame:
    """All windows of the events table, a file or a folder of part files, read as a stream until its end.

    Each batch writes the windows that it has changed to the shared folder, in parallel, so that the watermark frees the state of
    closed windows and no batch writes all of them again; the last state of each window counts.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern that only the table's own name meets: Spark streams from a folder or a pattern, not from one file
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    folder, found = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", windows(source, length, slide)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")

    job = found.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination()
    states = spark.createDataFrame([], found.schema.add("number", "int")) if missing(spark, f"{folder}/windows") else spark.read.parquet(f"{folder}/windows").drop("batch")
    last = states.groupBy("event_type", "start").agg(F.max_by(F.struct("mm", "n"), "number").alias("s"))
    return last.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "s.mm", "s.n")
