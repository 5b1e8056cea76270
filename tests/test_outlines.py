import random

from tidemark.operators import outlines


def frame(spark, cells):
    return spark.createDataFrame([(k, r, c, 0) for k, r, c in cells], "component long, row int, col int, pos int").repartition(3)


def shoelace(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def covered(rings, row, col):
    """Even-odd membership of a cell's middle."""
    x, y, inside = col + 0.5, row + 0.5, False
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            if (a["y"] > y) != (b["y"] > y):
                inside ^= x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
    return inside


def traced(cells):
    """The outlines of cells that don't touch at corners, walked edge by edge."""
    after = {}
    for r, c in cells:
        for dr, dc, x1, y1, x2, y2 in ((-1, 0, 1, 0, 0, 0), (0, -1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 1), (0, 1, 1, 1, 1, 0)):
            if (r + dr, c + dc) not in cells:
                after.setdefault((c + x1, r + y1), []).append((c + x2, r + y2))
    out = []
    while after:
        at = start = min(after)
        before, ring = None, []
        while True:
            options = after[at]
            follow = options[0] if before is None else max(options, key=lambda o: ((o[0] - at[0]) * (at[1] - before[1]) - (o[1] - at[1]) * (at[0] - before[0]), o))
            options.remove(follow)
            if not options:
                del after[at]
            ring.append((at, follow))
            before, at = at, follow
            if at == start:
                break
        corners = [a for (a, b), (p, q) in zip(ring, ring[-1:] + ring[:-1]) if (b[0] - a[0], b[1] - a[1]) != (q[0] - p[0], q[1] - p[1])]
        k = corners.index(min(corners))
        out.append(tuple(corners[k:] + corners[:k]))
    return sorted(out)


def rotated(ring):
    points = [(int(p["x"]), int(p["y"])) for p in ring]
    k = points.index(min(points))
    return tuple(points[k:] + points[:k])


def test_outlines_equal_those_walked_edge_by_edge(spark):
    rng = random.Random(3)
    cells = {k: {(rng.randrange(12), rng.randrange(12)) for _ in range(n)} for k, n in ((1, 40), (2, 90), (3, 1))}
    cells[4] = {(r, c) for r in range(9) for c in range(9) if not (2 <= r <= 6 and 2 <= c <= 6)} | {(4, 4)}
    got = outlines.rings(outlines.outline_edges(frame(spark, [(k, *p) for k, own in cells.items() for p in own]))).collect()
    for k, own in cells.items():
        mine = [r["ring"] for r in got if r["component"] == k]
        assert sum(map(shoelace, mine)) == -len(own) or sum(map(shoelace, mine)) == len(own)
        assert all(covered(mine, r, c) == ((r, c) in own) for r in range(-1, 13) for c in range(-1, 13))
    assert sorted(rotated(r["ring"]) for r in got if r["component"] == 4) == traced(cells[4])
    assert sorted(rotated(r["ring"]) for r in got if r["component"] == 3) == traced(cells[3])


def test_polygons_with_holes_floor_and_limit(spark):
    cells = [(1, r, c) for r in range(9) for c in range(9) if not (2 <= r <= 6 and 2 <= c <= 6)] + [(1, r, c) for r in range(3, 6) for c in range(3, 6) if (r, c) != (4, 4)]
    cells += [(2, 20, c) for c in range(4)] + [(3, 30, 30)] + [(4, r, 40 + r) for r in range(3)]
    got = outlines.polygons(frame(spark, cells), width=10.0).collect()
    found = sorted((r["component"], r["area"], [len(x) for x in r["rings"]]) for r in got)
    assert found == [(1, 800.0, [4, 4]), (1, 5600.0, [4, 4]), (2, 400.0, [4]), (3, 100.0, [4]), (4, 100.0, [4]), (4, 100.0, [4]), (4, 100.0, [4])]
    ring = next(r["rings"] for r in got if r["area"] == 5600.0)
    assert abs(shoelace(ring[0])) == 8100 and abs(shoelace(ring[1])) == 2500
    some = outlines.polygons(frame(spark, cells), width=10.0, least_area=150.0, most=2).collect()
    assert sorted(r["area"] for r in some) == [800.0, 5600.0]


def test_simplified_polygons_and_empty(spark):
    stairs = [(1, r, c) for r in range(30) for c in range(r + 1)]
    ((_, _, area, (ring,)),) = outlines.polygons(frame(spark, stairs), tolerance=0.8).collect()
    assert area == len(stairs) and len(ring) <= 6 and abs(abs(shoelace(ring)) - area) < 40
    assert outlines.polygons(frame(spark, stairs[:0]), tolerance=1.0).count() == 0


def test_long_outlines_need_few_rounds(spark):
    snake = {(2 * r, c) for r in range(6) for c in range(25)} | {(2 * r + 1, 24 if r % 2 == 0 else 0) for r in range(5)}
    ((_, _, area, rings),) = outlines.polygons(frame(spark, [(1, *p) for p in snake])).collect()
    assert area == len(snake) and len(rings) == 1


def test_runs_of_small_tiles_make_the_same_rings(spark):
    rng = random.Random(9)
    cells = frame(spark, [(k, r, c) for k in (1, 2) for r in range(-12, 12) for c in range(-12, 12) if rng.random() < 0.7])
    edges = outlines.outline_edges(cells).cache()
    want = {tuple(r) for r in outlines.chained(edges, size=1 << 20).collect()}
    following = {}
    for k, ring, pos, corner, *e in want:
        following[k, ring, pos] = (e, corner)
    for (k, ring, pos), (e, corner) in following.items():
        before, _ = following[k, ring, pos - 1] if pos else following[k, ring, max(p for a, b, p in following if (a, b) == (k, ring))]
        assert before[2:] == e[:2] and corner == ((before[2] - before[0], before[3] - before[1]) != (e[2] - e[0], e[3] - e[1]))
        assert pos or tuple(ring) == tuple(e)
    assert len(want) == edges.count()
    for size in (1, 5):
        assert {tuple(r) for r in outlines.chained(edges, size=size).collect()} == want
