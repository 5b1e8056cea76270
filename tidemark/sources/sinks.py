"""Governed and deterministic outputs."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gates, ranking

# Texts that every published file carries.
DISCLAIMER = (
    "Statistical indicators derived from public data. Patterns may have legitimate explanations. Flood-control project locations are per DPWH/BetterGovPH records (MYPS planning coordinates; an estimated 10 to "
    "15 percent carry coordinate uncertainty per COA). This surface reports where money was allocated and where Sentinel-1 still observed flooding. It is not a finding of fraud, project failure, or causation. Specific "
    "allegations require independent investigation and corroboration."
)


def feature_json(geometry_type: str, coordinates: Column, properties: Sequence[str]) -> Column:
    """A GeoJSON feature as text; coordinates are nested arrays of [x, y]."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_layer(features: DataFrame, feature: Column, meta: dict, path: str) -> None:
    """Features as JSON lines, in parallel, and their meta record beside them: what readers of large layers need.

    A layer whose status isn't ok is written without features.
    """
    spark = features.sparkSession
    shown = features if meta.get("scan_status", "ok") == "ok" else features.limit(0)
    shown.select(feature.alias("value")).write.mode("overwrite").text(f"{path}/features")
    spark.range(1).select(F.lit(json.dumps(meta, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def write_governed(records: DataFrame, path: str, disclaimer: str = DISCLAIMER, expect_governed: bool = False) -> None:
    """Records as Parquet with the disclaimer on each; with ``expect_governed`` altered ones stop the write."""
    if expect_governed:
        if gates.governed(records, disclaimer).limit(1).count():
            raise gates.GateError("disclaimer missing or altered")
        records.write.mode("overwrite").parquet(path)
    else:
        records.withColumn("disclaimer", F.lit(disclaimer)).write.mode("overwrite").parquet(path)


def merged_cache(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old and new results by key; new ones win, numbers are rounded to three digits, rows are in order of the key."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    out = ranking.last_wins(both, key, [F.col("_seq")]).drop("_seq")
    return out.select(*[F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]).orderBy(key)


def exact_split(ids: Sequence[int], seed: int = 42, fraction: float = 0.3) -> tuple[list[int], list[int], str]:
    """(train, holdout, sha256) by a seeded shuffle of the sorted ids of an event registry, which is a small list by its nature."""
    import hashlib

    ordered = sorted(ids)
    places = list(range(len(ordered)))
    random.Random(seed).shuffle(places)
    held = set(places[: max(1, round(len(ordered) * fraction))])
    train = [x for i, x in enumerate(ordered) if i not in held]
    hold = [x for i, x in enumerate(ordered) if i in held]
    text = json.dumps({"train_ids": train, "holdout_ids": hold}, separators=(",", ":"), sort_keys=True)
    return train, hold, hashlib.sha256(text.encode()).hexdigest()


def filled(template: str, metrics: dict[str, object]) -> str:
    """A text with {{METRIC:key}} replaced; an unknown key is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in metrics:
            raise KeyError(m[1])
        return str(metrics[m[1]])

    return re.sub(r"\{\{METRIC:([A-Za-z0-9_.]+)\}\}", value, template)


def curve(scored: DataFrame, bins: int = 20) -> DataFrame:
    """bin, n, mean_p, observed: points of the reliability diagram of (y, p)."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("observed"))
