import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import cover, spatial, vector
from tidemark.plans import roads

XY = "array<struct<x:double,y:double>>"


def points(p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def lines(spark, rows):
    return vector.segments(spark.createDataFrame([(i, points(p)) for i, p in rows], f"id long, coords {XY}"), "id", "coords")


def water(spark, rows):
    return spatial.edges(spark.createDataFrame([(i, [points(r) for r in rs]) for i, rs in rows], f"poly_id long, rings array<{XY}>"))


def test_known_lengths_near_water(spark):
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    rows = [
        (1, [(-200, 50), (300, 50)]),  # straight through: 100 inside, 30 on each side
        (2, [(-200, 120), (300, 120)]),  # 20 above: the corners add what Pythagoras says
        (3, [(-200, 130), (300, 130)]),  # exactly 30 above
        (4, [(-200, 131), (300, 131)]),  # too far
        (5, [(10, 10), (20, 10), (20, 40)]),  # inside
        (6, [(150, -50), (150, 20), (110, 20)]),  # the last 20 metres
        (7, [(50, 50), (50, 50.5)]),
        (8, [(120, 120), (140, 140)]),  # from the corner outwards
    ]
    want = {1: 160, 2: 100 + 2 * math.sqrt(500), 3: 100, 5: 40, 6: 20, 7: 0.5, 8: 30 - 20 * math.sqrt(2)}
    for tile in (17.0, 1000.0):
        got = {r["id"]: r["near_len"] for r in vector.length_within(lines(spark, rows), water(spark, [(1, [square]), (2, [square])]), "id", 30.0, tile=tile).collect()}
        assert {k: round(v, 6) for k, v in got.items() if v > 1e-9} == {k: round(v, 6) for k, v in want.items()}


def test_lengths_against_close_samples(spark):
    rng = random.Random(4)
    polygons = [(i, [[(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randrange(3, 6))]]) for i in range(8)]
    rows = [(i, [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(3)]) for i in range(30)]
    edges = [(r[k], r[(k + 1) % len(r)]) for _, rs in polygons for r in rs for k in range(len(r))]
    got = {r["id"]: r["near_len"] for r in vector.length_within(lines(spark, rows), water(spark, polygons), "id", 4.0, tile=13.0).collect()}
    for i, p in rows:
        total = 0.0
        for (ax, ay), (bx, by) in zip(p, p[1:]):
            t = (np.arange(4000) + 0.5) / 4000
            x, y = ax + (bx - ax) * t, ay + (by - ay) * t
            near, inside = np.full(len(t), np.inf), np.zeros(len(t), dtype=bool)
            for _, rs in polygons:
                own = np.zeros(len(t), dtype=bool)
                for r in rs:
                    for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
                        own ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
                inside |= own
            for (x1, y1), (x2, y2) in edges:
                s = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
                near = np.minimum(near, np.hypot(x - x1 - s * (x2 - x1), y - y1 - s * (y2 - y1)))
            total += math.hypot(bx - ax, by - ay) * float(((near <= 4) | inside).mean())
        assert abs(got.get(i, 0.0) - total) < 0.4, i


def test_there_and_back_within_a_millimetre(spark):
    grid = spark.range(0, 400).select((F.lit(116.0) + (F.col("id") % 20) * 0.6).alias("lon"), (F.floor(F.col("id") / 20) * 1.1).alias("lat"))
    m = grid.withColumn("m", geo.utm(F.col("lon"), F.col("lat"))).withColumn("b", geo.utm_inverse(F.col("m.x"), F.col("m.y")))
    off = m.select(F.max(F.abs(F.col("b.x") - F.col("lon")) * 111_320), F.max(F.abs(F.col("b.y") - F.col("lat")) * 111_320)).first()
    assert max(off) < 1e-3


def test_published_lines_are_fine_where_wet(spark):
    bend = points([(121.0, 14.5), (121.01, 14.5003), (121.02, 14.5)])  # some 33 m off the chord
    straight = points([(121.0, 14.5), (121.01, 14.500005), (121.02, 14.5)])
    far = points([(121.0, 14.5), (121.01, 14.51), (121.02, 14.5)])
    rows = spark.createDataFrame([(1, bend), (2, bend), (3, straight), (4, far), (5, None), (6, bend[:1])], f"osm_id long, coords {XY}")
    exposed = spark.createDataFrame([(1, "flooded"), (2, "clear"), (3, "near"), (4, "clear"), (5, "near"), (6, "unknown")], "osm_id long, exposure string")
    got = {r["osm_id"]: r["geometry"] and [tuple(p) for p in r["geometry"]] for r in roads.published(rows, exposed).collect()}
    assert got[1] == [(121.0, 14.5), (121.01, 14.5003), (121.02, 14.5)] and got[2] == got[3] == [(121.0, 14.5), (121.02, 14.5)]
    assert len(got[4]) == 3 and got[5] is None and got[6] == [(121.0, 14.5)]


def test_long_segments_stand_in_the_tiles_they_pass(spark):
    long = lines(spark, [(1, [(0, 0), (100, 100)]), (2, [(0, 100), (100, 0)]), (3, [(50, 0), (50, 100)]), (4, [(100, 7), (0, 7)])])
    tiles = {}
    for r in vector._spread(long, 1.0).collect():
        tiles.setdefault(r["id"], set()).add((r["tx"], r["ty"]))
    assert all(len(t) < 410 for t in tiles.values())  # of 10,201 in the box
    for r in long.collect():
        for k in range(1000):
            t = (k + 0.5) / 1000
            assert (math.floor(r["x1"] + (r["x2"] - r["x1"]) * t), math.floor(r["y1"] + (r["y2"] - r["y1"]) * t)) in tiles[r["id"]]


def test_metres_of_arrays_are_those_of_the_expression(spark):
    grid = spark.range(0, 400).select((F.lit(116.0) + (F.col("id") % 20) * 0.6).alias("lon"), (F.floor(F.col("id") / 20) * 1.1).alias("lat"))
    rows = grid.withColumn("m", geo.utm(F.col("lon"), F.col("lat"))).collect()
    x, y = geo.utm_arrays(np.array([r["lon"] for r in rows]), np.array([float(r["lat"]) for r in rows]))
    assert np.allclose(x, [r["m"]["x"] for r in rows], rtol=0, atol=1e-6) and np.allclose(y, [r["m"]["y"] for r in rows], rtol=0, atol=1e-6)


def test_segments_in_metres_of_odd_lines(spark):
    bend = [(121.0, 14.5), (121.0, 14.5), (121.01, 14.5), (121.01, 14.51)]
    rows = [(1, points(bend)), (2, None), (3, []), (4, points(bend[:1])), (None, points(bend[1:3])), (5, [{"x": 121.0, "y": None}, *points(bend[2:])])]
    got = vector.utm_segments(spark.createDataFrame(rows, f"osm_id long, coords {XY}"), "osm_id", "coords").collect()
    assert sorted(str(r["osm_id"]) for r in got) == ["1", "1", "5", "None"]
    metric = spark.createDataFrame(rows, f"osm_id long, coords {XY}").withColumn("m", F.transform("coords", lambda p: geo.utm(p["x"], p["y"])))
    want = vector.segments(metric, "osm_id", "m").drop("seg")
    of = lambda found: sorted((str(r["osm_id"]), *(round(r[c], 6) for c in ("x1", "y1", "x2", "y2", "len"))) for r in found)
    assert of(got) == of(want.collect())


def test_no_filter_projects_roads_again(spark):
    at = lambda a, b: F.struct((121 + (F.col("id") % a) / 1000).alias("x"), (14.5 + (F.col("id") % b) / 1000).alias("y"))
    lines_ = spark.range(0, 50).select(F.col("id").alias("osm_id"), F.lit("trunk").alias("highway"), F.lit("").alias("ref"), F.lit("SLEX").alias("name"), F.array(at(7, 5), at(9, 8)).alias("coords"))
    found = roads.exposure(lines_, water(spark, [(1, [[(284000, 1603000), (285000, 1603000), (285000, 1605000)]])]), True)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sinh" not in plan and "atan2" not in plan


def test_tiles_fit_the_lines_and_crowded_ones_are_dealt_out(spark, monkeypatch):
    rng = random.Random(7)
    polygons = [(i, [[(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(4)]]) for i in range(5)]
    segs = lines(spark, [(i, [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(3)]) for i in range(40)])
    of = lambda tile: {r["id"]: tuple(round(r[c], 6) for c in ("len", "inside_len", "near_len")) for r in vector.lengths(segs, water(spark, polygons), "id", 4.0, tile=tile, whole="len").collect()}
    want = of(1000.0)
    size = {r["id"]: round(r["len"], 6) for r in segs.groupBy("id").agg(F.sum("len").alias("len")).collect()}
    assert {k: v[0] for k, v in want.items()} == size
    edge = cover.in_tiles(water(spark, polygons), "poly_id", [], 5.0, 4.0)
    larger, crowded = cover.fitted(cover.spread(segs, 5.0), edge, 5.0)
    assert larger > 4 and crowded.count() == 0 and cover.spread(segs, 5.0 * larger).count() < 4 * segs.count()
    assert of(5.0) == want
    monkeypatch.setattr(cover, "CROWD", 30)
    larger, crowded = cover.fitted(cover.spread(segs, 50.0), edge, 50.0)
    assert larger == 1 and crowded.agg(F.max("parts")).first()[0] > 1
    assert of(50.0) == want
    monkeypatch.setattr(cover, "CROWD", 1)
    assert cover.fitted(cover.spread(segs, 5.0), edge, 5.0)[0] == 1


def test_all_lines_are_simplified_at_once_as_each_by_itself(spark):
    def alone(x, y, tolerance):
        keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
        while todo:
            a, b = todo.pop()
            far = math.hypot(x[b] - x[a], y[b] - y[a])
            off = [abs((x[i] - x[a]) * (y[b] - y[a]) - (y[i] - y[a]) * (x[b] - x[a])) / far if far else math.hypot(x[i] - x[a], y[i] - y[a]) for i in range(a + 1, b)]
            if off and max(off) > tolerance:
                k = a + 1 + off.index(max(off))
                keep.add(k)
                todo += [(a, k), (k, b)]
        return [i in keep for i in range(len(x))]

    rng = random.Random(5)
    own = [[(rng.randrange(9), rng.randrange(9)) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 40]))] for _ in range(60)]
    own += [[*p, p[0]] for p in own if p]
    flat, tolerance = np.array([q for p in own for q in p], dtype=float), np.array([rng.choice([0.5, 1.0, 3.0]) for _ in own])
    got = vector._kept(np.array([len(p) for p in own]), flat[:, 0], flat[:, 1], tolerance)
    assert got.tolist() == [k for p, t in zip(own, tolerance) if p for k in alone([x for x, _ in p], [y for _, y in p], t)]
    rows = spark.createDataFrame([(i, points(p)) for i, p in enumerate(own)] + [(-1, None)], f"i long, c {XY}")
    found = {r["i"]: r["s"] for r in rows.select("i", vector.simplify("c", F.lit(1.0)).alias("s")).collect()}
    assert found[-1] is None and all(len(found[i]) == (sum(alone(*zip(*p), 1.0)) if p else 0) for i, p in enumerate(own))


def test_published_lines_hold_no_series_as_expression(spark):
    rows = spark.createDataFrame([(1, points([(121.0, 14.5), (121.01, 14.5003), (121.02, 14.5)]))], f"osm_id long, coords {XY}")
    found = roads.published(rows, spark.createDataFrame([(1, "near")], "osm_id long, exposure string"))
    assert "sinh" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
