"""Scores, shares and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(vector: Column, weights: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rounded ratio, 0 where the whole isn't positive."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def ids_hash(ids: Column, digits: int = 64) -> Column:
    """sha256 of the sorted ids as canonical JSON, or its first ``digits``."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ", "), F.lit("]")), 256), 1, digits)
