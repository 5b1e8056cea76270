"""Exact areas of unions and intersections of polygons, from their edges alone, tile by tile (``cover``).

Whatever lies inside by even-odd parity is covered, so holes, several parts and outlines that cross themselves need no repair. No polygon,
set or map is collected anywhere; a task sees the edges of one tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cover


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def union_area(edge: DataFrame, key: str, set_col: str | Column, tile: float) -> DataFrame:
    """set, area of the union of each set's polygons; edge: key, the set's columns, x1, y1, x2, y2. Sets without an area are left out."""
    rows = cover.in_tiles(edge.select(_column(set_col).alias("set"), F.col(key).alias("key"), "x1", "y1", "x2", "y2"), "key", ["set"], tile)

    def run(at: tuple, rows: pa.Table) -> pa.Table:
        found = cover.area(cover.tile_box(at[1].as_py(), at[2].as_py(), tile), cover.shape_of([rows]), np.zeros(1, dtype=bool))
        return pa.table([rows.column("set").slice(0, 1), pa.array([found])], ["set", "area"])

    parts = cover.by_tile(rows, "set").applyInArrow(run, f"set {rows.schema['set'].dataType.simpleString()}, area double")
    return parts.groupBy("set").agg(F.sum("area").alias("area")).where("area > 0")


def intersection_area(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_set: str | Column, b_set: str | Column, tile: float) -> DataFrame:
    """a_set, b_set, area of the intersections of each set's union of ``a`` with each one's of ``b``; pairs that share no area are left out."""

    def side(df: DataFrame, key: str, of: str | Column, name: str) -> DataFrame:
        e = df.select(_column(of).alias(name), F.to_json(F.struct(_column(of).alias("s"))).alias("of"), F.col(key).alias("key"), "x1", "y1", "x2", "y2")
        return cover.in_tiles(e, "key", [name, "of"], tile)

    def by_set(rows: pa.Table) -> list[pa.Table]:
        number = rows.column("of").combine_chunks().dictionary_encode().indices.to_numpy()
        return [rows.take(pa.array(np.flatnonzero(number == i))) for i in np.unique(number)]

    def run(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        box = cover.tile_box(at[0].as_py(), at[1].as_py(), tile)
        pairs = [(x, y) for x in by_set(left) for y in by_set(right)] if left.num_rows and right.num_rows else []
        found = [cover.area(box, cover.shape_of([x, y]), np.zeros(2, dtype=bool)) for x, y in pairs]
        sets = [pa.concat_arrays([pair[i].column(n).slice(0, 1).combine_chunks() for pair in pairs]) if pairs else rows.column(n).slice(0, 0) for i, (n, rows) in enumerate((("a_set", left), ("b_set", right)))]
        return pa.table([*sets, pa.array(found, pa.float64())], ["a_set", "b_set", "area"])

    one, two = side(a, a_key, a_set, "a_set"), side(b, b_key, b_set, "b_set")
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("a_set", one), ("b_set", two)))
    parts = cover.by_tile(one).cogroup(cover.by_tile(two)).applyInArrow(run, f"{schema}, area double")
    return parts.groupBy("a_set", "b_set").agg(F.sum("area").alias("area")).where("area > 0")
