import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import raster, tiles

SCHEMA = "row long, col int, v double, mean int"


def grid(rng, n, low=-20, high=30):
    places = {(rng.randrange(low, high), rng.randrange(low, high)) for _ in range(n)}
    return {k: rng.choice([None, float("nan"), 1.0, 2.5, rng.uniform(-9, 9)]) for k in places}


@pytest.mark.parametrize("offsets", [raster.square(1), raster.disc(1), raster.disc(4), [(0, 3), (2, -1)]])
@pytest.mark.parametrize("size", [4, 9, 64])
def test_neighbourhoods_against_brute_force(spark, offsets, size):
    cells = grid(random.Random(size + len(offsets)), 600)
    df = spark.createDataFrame([(*k, v, 0) for k, v in cells.items()], SCHEMA).repartition(3)
    got = {(r["row"], r["col"]): r for r in tiles.focal(df, offsets, ["mean", "median", "sum", "min", "max", "count"], size=size).collect()}
    assert set(got) == set(cells)
    for (i, j), r in got.items():
        x = [cells[i + a, j + b] for a, b in offsets if cells.get((i + a, j + b)) is not None and cells[i + a, j + b] == cells[i + a, j + b]]
        want = (sum(x) / len(x), median(x), sum(x), min(x), max(x)) if x else (None,) * 5
        assert r["count"] == len(x) and all((g is None and w is None) or math.isclose(g, w, abs_tol=1e-12) for g, w in zip((r["mean"], r["median"], r["sum"], r["min"], r["max"]), want))


def test_a_wide_disc_ships_each_cell_at_most_four_times(spark):
    df = spark.range(0, 90_000).select((F.col("id") % 300).alias("row"), F.floor(F.col("id") / 300).alias("col"), F.lit(1.0).alias("v"))
    copies = tiles.spread(df, ["v"], 10, 64).groupBy("row", "col").agg(F.count("*").alias("n"))
    assert copies.agg(F.max("n")).first()[0] == 4 and tiles.spread(df, ["v"], 10, 64).count() < 1.8 * 90_000
    r = tiles.focal(df, raster.disc(10), ["count", "median"], size=64).where("row = 150 and col = 150").first()
    assert (r["count"], r["median"]) == (len(raster.disc(10)), 1.0)


def test_slope_and_empty(spark):
    df = spark.createDataFrame([(r, c, float(3 * r + 4 * c), 0) for r in range(7) for c in range(7) if (r, c) != (3, 3)], SCHEMA)
    got = {(r["row"], r["col"]): r["slope"] for r in tiles.slope_degrees(df, 10.0, "v", 3).collect()}
    whole = {(r, c) for r in range(1, 6) for c in range(1, 6) if abs(r - 3) + abs(c - 3) > 1}
    assert {k for k, v in got.items() if v is not None} == whole and len(got) == 48
    assert all(math.isclose(got[k], math.degrees(math.atan(0.5))) for k in whole)
    assert tiles.focal(df.where("row > 99"), raster.square(1), ["mean"]).count() == 0


def test_masks(spark):
    rows = [(60.0, 0, 1.0, 10.0), (50.0, None, 4.0, 100.0), (None, 1, 1.0, 100.0), (None, None, 1.0, 10.0), (1.0, 0, 2.9, 500.0), (0.5, 0, 2.9, 500.0)]
    df = spark.createDataFrame(rows, "occ double, river int, slope double, elevation double")
    got = df.select(tiles.permanent_water(F.col("occ"), F.col("river")), tiles.slope_ok(F.col("slope")), tiles.flood_plausible(F.col("slope"), F.col("elevation"), F.col("occ"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (True, True, False), (True, True, False), (False, True, True), (False, True, True), (False, True, False)]


def test_components_pass_over_many_tiles(spark):
    rng = random.Random(5)
    cells = {(r, c) for r in range(-20, 20) for c in range(-20, 20) if rng.random() < 0.38}
    label = {}
    for start in sorted(cells):
        todo = [start] if start not in label else []
        while todo:
            r, c = todo.pop()
            if (r, c) in cells and (r, c) not in label:
                label[r, c] = start
                todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    frame = spark.createDataFrame(sorted(cells) + sorted(cells)[:50], "row long, col int")
    for size in (3, 7, 256):
        got = {(r["row"], r["col"]): (tuple(r["component"]), r["size"]) for r in raster.components(frame, size).collect()}
        assert got == {k: (v, list(label.values()).count(v)) for k, v in label.items()}
