"""Lines: lengths inside polygons and near them, simplification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo
from tidemark.operators import cover

_POINTS_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def segments(lines: DataFrame, key: str, coords: str) -> DataFrame:
    """key, seg, x1, y1, x2, y2, len of the segments of lines (array<struct<x,y>>, metric)."""
    pair = F.arrays_zip(F.slice(coords, 1, F.size(coords) - 1).alias("a"), F.slice(coords, 2, F.size(coords) - 1).alias("b"))
    s = lines.where(F.size(coords) >= 2).select(key, F.posexplode(pair).alias("seg", "p")).select(key, "seg", F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))
    return s.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("len > 0")


def utm_segments(lines: DataFrame, key: str, coords: str) -> DataFrame:
    """key, x1, y1, x2, y2, len in metres of the segments of lines (array<struct<x,y>>, degrees)."""

    def run(batches):
        for batch in batches:
            size, lon, lat = _flat(batch.column(1))
            x, y = geo.utm_arrays(lon, lat)
            first = np.ones(len(x), dtype=bool)
            first[np.cumsum(size)[size > 0] - 1] = False
            a = np.flatnonzero(first)
            length = np.hypot(x[a + 1] - x[a], y[a + 1] - y[a])
            some = length > 0
            a, of = a[some], np.repeat(np.arange(len(size)), np.maximum(size - 1, 0))[some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *map(pa.array, (x[a], y[a], x[a + 1], y[a + 1], length[some]))], [key, "x1", "y1", "x2", "y2", "len"])

    kind = lines.schema[key].dataType.simpleString()
    return lines.select(key, coords).mapInArrow(run, f"{key} {kind}, x1 double, y1 double, x2 double, y2 double, len double")


_spread = cover.spread


def length_inside(segs: DataFrame, edge: DataFrame, key: str, poly: str = "poly_id", tile: float = 1000.0) -> DataFrame:
    """key, inside_len: the length of each line in any of the polygons, so that overlapping polygons count once."""
    return cover.line_lengths(segs, edge, key, {"inside_len": 0.0}, poly, tile)


def length_within(segs: DataFrame, edge: DataFrame, key: str, metres: float, poly: str = "poly_id", tile: float = 1000.0) -> DataFrame:
    """key, near_len: the length of each line in the polygons or at most ``metres`` from them; what is near to several counts once."""
    return cover.line_lengths(segs, edge, key, {"near_len": metres}, poly, tile)


def lengths(segs: DataFrame, edge: DataFrame, key: str, metres: float, poly: str = "poly_id", tile: float = 1000.0, whole: str | None = None) -> DataFrame:
    """key, inside_len, near_len: both lengths in one pass; with ``whole`` so named, each line's own length too, and no line is missing."""
    return cover.line_lengths(segs, edge, key, {"inside_len": 0.0, "near_len": metres}, poly, tile, whole)


def _flat(coords: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many points each line has, and x and y of all of them."""
    size = pc.fill_null(pc.list_value_length(coords), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = coords.flatten()
    x, y = (pc.cast(pc.struct_field(flat, c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    return size, x, y


def _lines(size: np.ndarray, x: np.ndarray, y: np.ndarray, null: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(x, from_pandas=True), pa.array(y, from_pandas=True)], ["x", "y"])
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), points)


def _kept(size: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which points of the lines, laid end to end, stay: Douglas-Peucker, all lines at once, level by level."""
    keep, some = np.zeros(len(x), dtype=bool), size > 0
    b = np.cumsum(size)[some] - 1
    a, t = b + 1 - size[some], tolerance[some]
    keep[a] = keep[b] = True
    while True:
        wide = b - a >= 2
        a, b, t = a[wide], b[wide], t[wide]
        if not len(a):
            return keep
        n = b - a - 1
        starts, span = np.cumsum(n) - n, np.repeat(np.arange(len(a)), n)
        i = np.arange(len(span)) - starts[span] + a[span] + 1
        dx, dy = (x[b] - x[a])[span], (y[b] - y[a])[span]
        px, py, far = x[i] - x[a][span], y[i] - y[a][span], np.hypot(dx, dy)
        off = np.where(far > 0, np.abs(px * dy - py * dx) / np.where(far > 0, far, 1), np.hypot(px, py))
        most = np.maximum.reduceat(off, starts)
        at = np.flatnonzero((off == most[span]) & (most > t)[span])
        split, first = np.unique(span[at], return_index=True)
        m = i[at[first]]
        keep[m] = True
        a, b, t = np.concatenate([a[split], m]), np.concatenate([m, b[split]]), np.concatenate([t[split], t[split]])


@F.arrow_udf(_POINTS_TYPE)
def simplify(coords: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Douglas-Peucker: points that stand off by more than the tolerance; ends stay."""
    size, x, y = _flat(coords)
    keep = _kept(size, x, y, tolerance.to_numpy(zero_copy_only=False))
    left = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
    return _lines(left, x[keep], y[keep], coords.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(_POINTS_TYPE)
def utm_simplify(coords: pa.Array, tolerance: pa.Array) -> pa.Array:
    """simplify() of lines in degrees, by metres of ``geo.utm``."""
    size, lon, lat = _flat(coords)
    x, y = geo.utm_arrays(lon, lat)
    keep = _kept(size, x, y, tolerance.to_numpy(zero_copy_only=False))
    left = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
    lon, lat = geo.utm_inverse_arrays(x[keep], y[keep])
    return _lines(left, lon, lat, coords.is_null().to_numpy(zero_copy_only=False))
