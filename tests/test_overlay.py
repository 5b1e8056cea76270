import math
import random

import numpy as np
import pytest

from tidemark.operators import overlay, spatial
from tidemark.queries import geometry

RINGS = "poly_id long, day string, rings array<array<struct<x:double,y:double>>>"


def frame(spark, polygons):
    """Edges of (poly_id, set, rings of (x, y))."""
    rows = [(i, d, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]) for i, d, rs in polygons]
    df = spark.createDataFrame(rows, RINGS)
    return spatial.edges(df).join(df.select("poly_id", "day"), "poly_id")


def square(x, y, w, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def mask(rings, xs, ys):
    """Even-odd membership of grid points."""
    inside = np.zeros((len(ys), len(xs)), dtype=bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if y1 != y2:
                rows = (y1 > ys) != (y2 > ys)
                cut = (x2 - x1) * (ys - y1) / (y2 - y1) + x1
                inside ^= rows[:, None] & (xs[None, :] < cut[:, None])
    return inside


def union_of(polygons, xs, ys):
    out = {}
    for _, d, rings in polygons:
        out[d] = out.get(d, False) | mask(rings, xs, ys)
    return out


def star(rng, x, y, size, n=7):
    """A polygon whose outline may cross itself."""
    return [(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in rng.sample([2 * math.pi * k / n for k in range(n)], n)]


def areas(df, *keys):
    return {tuple(r[k] for k in keys): r["area"] for r in df.collect()}


def test_known_unions(spark):
    polygons = [
        (1, "apart", [square(0, 0, 2)]), (2, "apart", [square(5, 5, 1)]),
        (3, "cross", [square(0, 1, 3, 1)]), (4, "cross", [square(1, 0, 1, 3)]),
        (5, "hole", [square(0, 0, 4), square(1, 1, 2)]), (6, "hole", [square(1.5, 1.5, 1)]),
        (7, "same", [square(0, 0, 2)]), (8, "same", [square(0, 0, 2)]), (9, "same", [list(reversed(square(0, 0, 2)))]),
        (10, "edge", [square(0, 0, 2)]), (11, "edge", [square(2, 0, 2)]), (12, "edge", [square(1, 2, 2)]), (13, "edge", [square(0.5, 0, 1)]),
        (14, "bow", [[(0, 0), (2, 2), (2, 0), (0, 2)]]), (15, None, [[(0, 0), (1, 0), (0, 1)]]), (16, "corner", [square(0, 0, 1)]), (17, "corner", [square(1, 1, 1)]),
        (18, "spike", [[(0, 0), (2, 0), (2, 2), (5, 2), (2, 2), (0, 2)]]),
    ]
    want = {"apart": 5, "cross": 5, "hole": 13, "same": 4, "edge": 12, "bow": 2, None: 0.5, "corner": 2, "spike": 4}
    for tile in (0.7, 10.0):
        got = areas(overlay.union_area(frame(spark, polygons), "poly_id", "day", tile), "set")
        assert {k: round(v, 9) for (k,), v in got.items()} == want


def test_known_intersections(spark):
    units = [(1, "a", [square(0, 0, 4)]), (2, "b", [[(10, 0), (14, 0), (10, 4)]]), (3, "c", [square(100, 0, 1)])]
    floods = [(11, "x", [square(1, 1, 1)]), (12, "x", [square(1.5, 1, 1)]), (13, "y", [square(0, 0, 4)]), (14, "y", [square(9, -1, 2, 3)]), (15, "z", [square(4, 0, 3)]), (16, "x", [square(12, 0, 4, 1)])]
    want = {("a", "x"): 1.5, ("a", "y"): 16, ("b", "y"): 2, ("b", "x"): 1.5}
    for tile in (0.9, 25.0):
        got = areas(overlay.intersection_area(frame(spark, units), frame(spark, floods), "poly_id", "poly_id", "day", "day", tile), "a_set", "b_set")
        assert {k: round(v, 9) for k, v in got.items()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_crossing_outlines_against_a_fine_grid(spark, seed):
    rng = random.Random(seed)
    floods = [(i, f"d{i % 3}", [star(rng, rng.uniform(2, 8), rng.uniform(2, 8), 3)]) for i in range(12)]
    units = [(100 + i, f"u{i}", [star(rng, 3 + 4 * (i % 2), 3 + 4 * (i // 2), 3.5, 5), square(3 + 4 * (i % 2), 3 + 4 * (i // 2), 0.5)]) for i in range(4)]
    step = 0.01
    xs = ys = np.arange(-2, 12, step) + step / 2 + 1e-7
    wet, land = union_of(floods, xs, ys), union_of(units, xs, ys)
    got = areas(overlay.union_area(frame(spark, floods), "poly_id", "day", 1.3), "set")
    assert {k for (k,) in got} == set(wet) and all(abs(got[k,] - wet[k].sum() * step * step) < 0.05 for k in wet)
    got = areas(overlay.intersection_area(frame(spark, units), frame(spark, floods), "poly_id", "poly_id", "day", "day", 1.3), "a_set", "b_set")
    for u in land:
        for d in wet:
            assert abs(got.get((u, d), 0.0) - (land[u] & wet[d]).sum() * step * step) < 0.05


def test_far_coordinates_and_empty_tables(spark):
    polygons = [(1, "m", [square(300_000, 1_600_000, 50)]), (2, "m", [square(300_025, 1_600_000, 50)])]
    assert abs(areas(overlay.union_area(frame(spark, polygons), "poly_id", "day", 1000.0), "set")["m",] - 3750) < 1e-6
    none = frame(spark, polygons).where("poly_id > 5")
    assert overlay.union_area(none, "poly_id", "day", 10.0).count() == 0
    assert overlay.intersection_area(none, frame(spark, polygons), "poly_id", "poly_id", "day", "day", 1000.0).count() == 0


def test_edges_take_columns_of_their_polygon_along(spark):
    rows = [(i, d, [[{"x": float(x), "y": float(y)} for x, y in square(i, 0, 1)]]) for i, d in ((1, "a"), (2, None), (2, "b"))]
    got = spatial.edges(spark.createDataFrame(rows, RINGS), also=("day",)).collect()
    assert sorted((r["poly_id"], r["day"] or "") for r in got) == sorted((i, d) for i, d in ((1, "a"), (2, ""), (2, "b")) for _ in range(4))


def joins_in(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture(scope="module")
def places(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("places"))
    spark.range(1, 40).selectExpr("id as c_custkey", "concat('d', id % 3) as c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 25).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{folder}/nation.parquet")
    return folder


def test_overlaps_join_no_table_of_polygons(spark, places):
    # only the results of the units meet their areas; polygons joined by key were broadcast, since compressed files look small
    assert joins_in(geometry.q_overlap_exact(spark, places)) == 1


def test_unions_join_no_table_of_polygons(spark, places):
    assert joins_in(geometry.q_union_area(spark, places)) == 0
