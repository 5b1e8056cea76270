import random

import numpy as np

from tidemark.operators import cover, overlay, spatial, vector

RINGS = "poly_id long, day string, rings array<array<struct<x:double,y:double>>>"


def boxes(n, seed=3):
    """Boxes (x1, y1, x2, y2) with whole corners on a map of 32 by 32."""
    rng = random.Random(seed)
    corners = [(rng.randrange(-4, 30), rng.randrange(-4, 30)) for _ in range(n)]
    return [(x, y, x + rng.randrange(3, 9), y + rng.randrange(3, 7)) for x, y in corners]


def edges(spark, own):
    rows = [(i, "d", [[{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d))]]) for i, (a, b, c, d) in enumerate(own)]
    df = spark.createDataFrame(rows, RINGS)
    return spatial.edges(df).join(df.select("poly_id", "day"), "poly_id")


def shape(own):
    sides = [[(a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d)] for a, b, c, d in own]
    return cover.Shape(np.array(sides, dtype=float).reshape(-1, 4), np.repeat(np.arange(len(own)), 4), np.array([a <= 0 < c and b <= 0 < d for a, b, c, d in own]), np.zeros(len(own), dtype=np.int64))


def test_work_does_not_grow_with_the_pairs_that_cross(monkeypatch):
    work, real = [0], cover.covered

    def counted(p, q, box, s, full):
        work[0] += len(p) * len(s.e)
        return real(p, q, box, s, full)

    monkeypatch.setattr(cover, "covered", counted)
    seen = []
    for n in (500, 4000):
        own, work[0] = boxes(n), 0
        cells = {(x, y) for a, b, c, d in own for x in range(max(a, 0), min(c, 32)) for y in range(max(b, 0), min(d, 32))}
        assert cover.area((0.0, 0.0, 32.0, 32.0), shape(own), np.zeros(1, dtype=bool)) == len(cells)
        p, share = np.array([[0.0, k + 0.05] for k in range(32)]), np.zeros(32)
        cover.lengths((0.0, 0.0, 32.0, 32.0), shape(own), p, np.repeat([[32.0, 0.0]], 32, axis=0), np.arange(32), 0.0, share)
        assert np.allclose(share * 32, [sum((x, k) in cells for x in range(32)) for k in range(32)])
        seen.append(work[0])
    assert seen[1] < 8 * max(seen[0], 1)


def test_a_dense_map(spark):
    own = boxes(3000)
    cells = {(x, y) for a, b, c, d in own for x in range(a, c) for y in range(b, d)}
    (row,) = overlay.union_area(edges(spark, own), "poly_id", "day", 16.0).collect()
    assert row["area"] == len(cells)


def test_lines_along_borders_and_edges_count_once(spark):
    own = [(0, 0, 8, 8), (4, 2, 12, 6)]
    lines = [(1, [(-4, 4), (16, 4)]), (2, [(4, -4), (4, 16)]), (3, [(-4, -4), (12, 12)]), (4, [(16, 4), (-4, 4)]), (5, [(20, 20), (30, 20)])]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in lines], "id long, coords array<struct<x:double,y:double>>")
    segs = vector.segments(df, "id", "coords")
    want = {1: (12, 14), 2: (8, 10), 3: (8 * 2**0.5, 8 * 2**0.5 + 2), 4: (12, 14)}
    for tile in (4.0, 64.0):
        got = {r["id"]: (r["inside_len"], r["near_len"]) for r in vector.lengths(segs, edges(spark, own), "id", 1.0, tile=tile).collect()}
        assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(float(x), 9) for x in v) for k, v in want.items()}
