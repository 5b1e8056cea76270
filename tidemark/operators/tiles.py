"""Neighbourhoods of raster cells, tile by tile.

A tile is a square of cells. Each cell goes to its own tile and to those whose border it is near to, which for tiles at least twice as wide as
the neighbourhood reaches are at most four; one shuffle brings a tile and its surroundings together as arrays, and a tile is a bounded
piece of work however many cells there are and however they are spread.

Cells are rows (row, col and bands); missing cells, NULLs and NaNs take no part. If a cell is there several times, one of its values holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, STACK_BYTES = 256, 64 << 20

#: From each band's array and the cells that exist, both with their surroundings, to each result's array of the tile itself.
Compute = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def spread(cells: DataFrame, bands: list[str], reach: int, size: int) -> DataFrame:
    """tr, tc, row, col and bands: each cell in its tile and in those that its neighbourhood reaches into."""
    near = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-reach, 0, reach))), lambda d: F.floor((F.col(c) + d) / F.lit(size)).cast("long")))
    return cells.select("row", "col", *bands, F.explode(near("row")).alias("tr")).select("*", F.explode(near("col")).alias("tc"))


def over_tiles(cells: DataFrame, bands: list[str], reach: int, compute: Compute, results: dict[str, str], size: int = SIZE) -> DataFrame:
    """row, col and ``results`` (name -> SQL type) of every cell, by ``compute`` for each tile."""
    size = max(size, 2 * reach, 1)
    kinds = {f.name: f.dataType.simpleString() for f in cells.select("row", "col").schema}
    wide = size + 2 * reach
    own = (slice(reach, reach + size), slice(reach, reach + size))
    to_arrow = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * size - reach, key[1].as_py() * size - reach
        r, c = (table.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
        there = np.zeros((wide, wide), dtype=bool)
        there[r - top, c - left] = True
        arrays = {}
        for b in bands:
            arrays[b] = np.full((wide, wide), np.nan)
            arrays[b][r - top, c - left] = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
        found = compute(arrays, there)
        rows, columns = np.nonzero(there[own])
        out = [pa.array(rows + key[0].as_py() * size).cast(table.schema.field("row").type), pa.array(columns + key[1].as_py() * size).cast(table.schema.field("col").type)]
        for n, t in results.items():
            x = found[n][rows, columns]
            out.append(pa.array(x, to_arrow[t], mask=np.isnan(x)) if t == "double" else pa.array(x, to_arrow[t]))
        return pa.table(out, ["row", "col", *results])

    schema = f"row {kinds['row']}, col {kinds['col']}, " + ", ".join(f"{n} {t}" for n, t in results.items())
    return spread(cells, bands, reach, size).groupBy("tr", "tc").applyInArrow(run, schema)


def _shifted(x: np.ndarray, reach: int, i: int, j: int) -> np.ndarray:
    """What lies i rows and j columns from each cell of the tile."""
    n = x.shape[0] - 2 * reach
    return x[reach + i : reach + i + n, reach + j : reach + j + n]


def focal(cells: DataFrame, offsets: list[tuple[int, int]], stats: list[str], band: str = "v", size: int = SIZE) -> DataFrame:
    """row, col and ``stats`` (mean, median, sum, min, max: double; count: long) of ``band`` over the neighbourhood (offsets) of each cell.

    Every statistic but the count is NULL where the neighbourhood holds no value.
    """
    reach = max((max(abs(i), abs(j)) for i, j in offsets), default=0)

    def compute(arrays: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        x = arrays[band]
        known = ~np.isnan(x)
        n = x.shape[0] - 2 * reach
        count = sum((_shifted(known, reach, i, j).astype(np.int64) for i, j in offsets), np.zeros((n, n), dtype=np.int64))
        out = {"count": count}
        if {"mean", "sum"} & set(stats):
            zero = np.where(known, x, 0.0)
            total = sum((_shifted(zero, reach, i, j) for i, j in offsets), np.zeros((n, n)))
            out["sum"] = np.where(count > 0, total, np.nan)
            out["mean"] = np.divide(total, count, out=np.full((n, n), np.nan), where=count > 0)
        for name, worst, pick in (("min", np.inf, np.minimum), ("max", -np.inf, np.maximum)):
            if name in stats:
                best = np.full((n, n), worst)
                for i, j in offsets:
                    pick(best, _shifted(np.where(known, x, worst), reach, i, j), out=best)
                out[name] = np.where(count > 0, best, np.nan)
        if "median" in stats:
            out["median"] = np.full((n, n), np.nan)
            step = max(1, STACK_BYTES // (8 * n * max(1, len(offsets))))
            for a in range(0, n, step):
                b = min(n, a + step)
                stack = np.sort(np.stack([_shifted(x, reach, i, j)[a:b] for i, j in offsets]), axis=0)  # NaNs come last
                k = count[a:b]
                low, high = (np.take_along_axis(stack, np.maximum(0, m)[None], axis=0)[0] for m in ((k - 1) // 2, k // 2 - (k == 0)))
                out["median"][a:b] = np.where(k > 0, (low + high) / 2, np.nan)
        return out

    return over_tiles(cells, [band], reach, compute, {s: "long" if s == "count" else "double" for s in stats}, size)


def slope_degrees(cells: DataFrame, width: float, band: str = "elevation", size: int = SIZE) -> DataFrame:
    """row, col, slope from the gradients between the four neighbours of cells ``width`` wide; NULL where one of them is missing."""

    def compute(arrays: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        at = lambda i, j: _shifted(arrays[band], 1, i, j)
        dx, dy = (at(0, 1) - at(0, -1)) / (2 * width), (at(1, 0) - at(-1, 0)) / (2 * width)
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))
        return {"slope": np.where(np.isnan(at(0, 0)), np.nan, slope)}

    return over_tiles(cells, [band], 1, compute, {"slope": "double"}, size)


def permanent_water(occurrence: Column, river: Column, least: float = 50.0) -> Column:
    """Water that is always there: seen in at least ``least`` percent of the time, or a cell of the river network; NULLs count as no."""
    return F.coalesce(occurrence >= least, F.lit(False)) | F.coalesce(river > 0, F.lit(False))


def slope_ok(slope: Column, most: float = 5.0) -> Column:
    """Ground on which water can stand."""
    return slope < most


def flood_plausible(slope: Column, elevation: Column, occurrence: Column) -> Column:
    """Near flat, and low or with water at some time; without a slope or an elevation the answer is NULL unless it is clear from the rest."""
    return (slope < 3.0) & ((elevation < 30.0) | (F.coalesce(occurrence, F.lit(0.0)) >= 1.0))
