import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.geo import utm
from tidemark.operators import gates, joins, outlines, ranking, raster, rollups, spatial, vector
from tidemark.plans import accountability, extent, lookup, roads


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def polygons(spark, rows, key="poly_id long"):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]) for i, rs in rows], f"{key}, rings array<array<struct<x:double,y:double>>>")


def test_points_in_polygons_move_with_them(spark):
    rng = random.Random(1)
    shape = [(1, [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 6), (3, 6)]]), (2, [[(5, 5), (15, 5), (10, 14)]]), (3, [[(1, 1), (2, 2)]])]
    points = [(i, rng.uniform(-2, 17), rng.uniform(-2, 16)) for i in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0)]

    def hits(dx, dy, tile):
        moved = [(i, [[(x + dx, y + dy) for x, y in r] for r in rs]) for i, rs in shape]
        p = frame(spark, [(i, None if x is None else x + dx, y + dy) for i, x, y in points], "id long, x double, y double").repartition(3)
        return {tuple(r) for r in spatial.inside(p, spatial.edges(polygons(spark, moved)), "id", "x", "y", tile=tile).collect()}

    want = {(i, 1) for i, x, y in points if x is not None and 0 <= x < 10 and 0 <= y < 10 and not (3 <= x < 6 and 3 <= y < 6)}
    plain = hits(0, 0, 1.0)
    assert {h for h in plain if h[1] == 1} == want and any(h[1] == 2 for h in plain)
    assert hits(1024, -512, 7.0) == plain


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    km = lambda a, b: 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    points = [(i, rng.uniform(-80, 80), rng.uniform(-179, 179)) for i in range(60)]
    sites = [(i, rng.uniform(0, 20), rng.uniform(110, 130)) for i in range(25)]
    got = {r["id"]: (r["site_id"], round(r["km"], 6)) for r in spatial.nearest(frame(spark, points, "id long, lat double, lon double"), frame(spark, sites, "site_id long, lat double, lon double")).collect()}
    assert got == {i: min((round(km((a, b), (c, d)), 6), s) for s, c, d in sites)[::-1] for i, a, b in points}
    close = {(r["id"], r["site_id"]) for r in spatial.within_km(frame(spark, sites, "id long, lat double, lon double"), frame(spark, sites, "site_id long, lat double, lon double"), 300.0).collect()}
    assert close == {(i, j) for i, a, b in sites for j, c, d in sites if km((a, b), (c, d)) <= 300}


def test_nearest_in_one_dense_degree(spark):
    rng = random.Random(8)
    km = lambda a, b: 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    sites = [(i, 14 + rng.random(), 121 + rng.random()) for i in range(900)] + [(2000 - i, 14.5, 121.5) for i in range(600)]
    points = [(i, 14 + rng.random(), 121 + rng.random()) for i in range(150)] + [(500 + i, 14.5, 121.5) for i in range(50)] + [(900, 20.0, 119.0), (901, None, 1.0)]
    near, wide = frame(spark, points, "id long, lat double, lon double"), frame(spark, sites, "site_id long, lat double, lon double")
    got = {r["id"]: (r["site_id"], round(r["km"], 6)) for r in spatial.nearest(near, wide, most=20).collect()}
    assert got == {i: min((round(km((a, b), (c, d)), 6), s) for s, c, d in sites)[::-1] for i, a, b in points if a is not None}
    places = wide.select("lat", "lon").distinct()
    width = spatial.dense_cell(places, 1.0, 20)
    fullest = places.groupBy(F.floor(F.col("lat") / width), F.floor(F.col("lon") / width)).count().agg(F.max("count")).first()[0]
    assert width < 0.25 and fullest <= 20 and spatial.dense_cell(wide, 1.0, 20, 0.1) == 0.125


def test_nearest_ties_to_a_millimetre(spark):
    # three sites to the west, east and south, equally far but for the last digits of a double
    sites = frame(spark, [(9, 10.0, 119.9), (4, 10.0, 120.1), (7, 10.0, 120.1), (5, 10.3, 120.0)], "site_id long, lat double, lon double")
    points = frame(spark, [(i, 10.0, 120.0 + i * 1e-10) for i in range(-4, 5)], "id long, lat double, lon double")
    assert {r["site_id"] for r in spatial.nearest(points, sites).collect()} == {4}
    assert {r["site_id"] for r in spatial.nearest(points, sites.withColumn("site_id", -F.col("site_id"))).collect()} == {-9}


def test_all_sites_of_crowded_places(spark):
    where = [(0.0, 179.95), (0.0, -179.95), (0.1, 179.9), (3.0, 0.0)]
    points = frame(spark, [(i, *where[i % 4]) for i in range(40)], "id long, lat double, lon double")
    sites = frame(spark, [(i, *where[i % 3]) for i in range(3000)], "site_id long, lat double, lon double")
    got = spatial.within_km(points, sites, 30.0).groupBy("id").agg(F.countDistinct("site_id").alias("n"), F.count("*").alias("m")).collect()
    assert {(r["id"], r["n"], r["m"]) for r in got} == {(i, 3000, 3000) for i in range(40) if i % 4 < 3}
    assert max(r["n"] for r in spatial._at_places(sites, "site_id", "s", 100).select(F.size("s").alias("n")).collect()) < 250


def test_boundaries_of_words_are_those_of_ascii(spark):
    rows = [("und und\u00dfverc",), ("x\u00fcund und",), ("und und",), ("und undx",), ("und und_",), ("an und und.",)]
    found = frame(spark, rows, "t string").where(F.col("t").rlike(text.ascii_bounds(r"\bund und\b"))).collect()
    assert [r["t"] for r in found] == [rows[i][0] for i in (0, 1, 2, 5)]
    assert text.ascii_bounds(r"\\b\d") == r"\\b\d"


def test_best_along_a_corridor_in_both_modes(spark):
    s = frame(spark, [(1, 0, 0.9, 5.0), (1, 1, 0.3, 2.0), (1, 2, 0.5, 3.0)], "id long, i int, score double, km double")
    assert spatial.best_along(s).collect()[0][1:] == (0.9, 2.0)
    assert spatial.best_along(s, compatible=True).collect()[0][1:] == (0.5, 2.0)


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(3)
    sets = [(i, rng.choice("ab"), [rng.choice("pqrstu") for _ in range(rng.randrange(1, 6))]) for i in range(60)]
    left = frame(spark, sets, "left_id long, p string, tokens array<string>")
    got = {(r[0], r[1]) for r in joins.jaccard_join(left, left.withColumnRenamed("left_id", "right_id"), ["p"], 0.6).collect()}
    assert got == {(a, b) for a, p, x in sets for b, q, y in sets if p == q and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_earlier_alike_rows_equal_brute_force(spark, span):
    rng = random.Random(3)
    rows = [(i * 3 % 200, "ab"[i % 2], rng.choices("pqrst", k=rng.randrange(1, 5))) for i in range(200)]
    got = {r["left_id"]: (r["right_id"], r["n"]) for r in joins.jaccard_earlier(frame(spark, rows, "id long, p string, tokens array<string>"), ["p"], 0.6, span).collect()}
    want = {}
    for i, p, t in rows:
        less = [j for j, q, u in rows if j < i and p == q and len({*t} & {*u}) / len({*t} | {*u}) >= 0.6]
        if less:
            want[i] = (min(less), len(less))
    assert got == want


def test_copies_are_not_made_into_pairs(spark):
    rows = spark.range(20_000).select("id", F.lit("a").alias("p"), F.array(F.lit("x"), F.lit("y")).alias("tokens"))
    found = joins.jaccard_earlier(rows, ["p"], 0.6, 512)
    assert found.agg(F.min("right_id"), F.max("right_id"), F.sum("n"), F.count("*")).first() == (0, 0, 19_999 * 20_000 // 2, 19_999)


def test_text_join_prefers_exact_to_prefix(spark):
    left = frame(spark, [(1, "quezon city"), (2, "quezon"), (3, "que"), (4, "other"), (5, "")], "left_id long, text string")
    right = frame(spark, [(1, "quezon province"), (2, "quezon")], "right_id long, text string")
    assert {tuple(r) for r in joins.text_join(left, right).collect()} == {(1, 2), (2, 2), (3, 1)}


def test_later_passes(spark):
    df = spark.sql("select array(date'2024-03-01', date'2024-01-01', date'2024-03-01', date'2024-02-01') p, explode(array(date'2024-01-15', date'2024-03-01', cast(null as date))) d")
    assert [[d.isoformat() for d in r[0]] for r in df.select(joins.later_passes(F.col("p"), F.col("d"))).collect()] == [["2024-02-01", "2024-03-01"], [], []]


def test_otsu_between_modes(spark):
    rng = random.Random(4)
    cells = frame(spark, [(rng.gauss(-22, 0.8),) for _ in range(900)] + [(rng.gauss(-12, 1.0),) for _ in range(2500)], "v double")
    t = raster.otsu(raster.histogram(cells, F.col("v"))).first()[0]
    assert -21 < t < -13
    constant = raster.otsu(raster.histogram(cells.select(F.lit(-15.0).alias("v")), F.col("v")))
    assert constant.first()[0] == -15.0 and raster.otsu(raster.histogram(cells.limit(0), F.col("v"))).count() == 0


def test_otsu_of_many_cells(spark):
    rows = [(b, 2_000_000_000 if b < 4 else 1_000_000_000, float(b)) for b in (0, 1, 2, 3, 8, 9)]
    assert raster.otsu(spark.createDataFrame(rows, "bucket long, n long, mean double")).first()[0] == 3.0


def test_components_equal_flood_fill(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(14), rng.randrange(14)) for _ in range(95)} | {(30, c) for c in range(40)}
    got = {(r["row"], r["col"]): (tuple(r["component"]), r["size"]) for r in raster.components(frame(spark, sorted(cells), "row int, col int").repartition(3)).collect()}
    left, want = set(cells), {}
    while left:
        todo, own = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.discard(c)
                own.add(c)
                todo += [(c[0] + i, c[1] + j) for i, j in product((-1, 0, 1), repeat=2)]
        want |= {c: (min(own), len(own)) for c in own}
    assert got == want


def test_detection_equals_cell_by_cell(spark):
    rng = random.Random(6)
    size = 16
    wet = {(r, c) for r in range(4, 12) for c in range(3, 11)}
    cells = [(r, c, rng.gauss(-21 if (r, c) in wet else -10, 0.5), -10.0, c == 5, 1.0 if r < 11 else 9.0, True) for r in range(size) for c in range(size)]
    got = {(r["row"], r["col"]) for r in extent.detect(frame(spark, cells, "row int, col int, vh double, base_vh double, perm boolean, slope double, plausible boolean")).collect()}
    by = {(r, c): x for r, c, *x in cells}

    def around(v, offsets, r, c):
        return [v[r + i, c + j] for i, j in offsets if (r + i, c + j) in v]

    median = lambda x: (sorted(x)[len(x) // 2] + sorted(x)[(len(x) - 1) // 2]) / 2
    smooth = {k: median(around({q: y[0] for q, y in by.items()}, raster.disc(1), *k)) for k in by}
    raw = {k: float(smooth[k] < -14.0 and smooth[k] + 10 < -1 and not by[k][2] and by[k][3] < 5) for k in by}
    t = extent.threshold(frame(spark, [(v,) for v in smooth.values()], "vh double")).first()[0]
    raw = {k: float(smooth[k] < t and smooth[k] + 10 < -1 and not by[k][2] and by[k][3] < 5) for k in by}
    mean = {k: float(sum(x := around(raw, raster.square(1), *k)) / len(x) > 0.42) for k in by}
    mode = {k for k in by if sum(x := around(mean, raster.disc(1), *k)) / len(x) > 0.5 and not by[k][2]}
    assert got == {k for k in mode if k[1] > 5} | {k for k in mode if k[1] < 5 and sum(q[1] < 5 for q in mode) >= 12}


def test_outlines_enclose_their_cells(spark):
    cells = [(1, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(2, 9, 9)]
    rings = outlines.rings(outlines.outline_edges(frame(spark, cells, "component long, row int, col int"))).collect()
    area = lambda r: abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:] + r[:1]))) / 2
    assert sorted((r["component"], area(r["ring"]), len(r["ring"])) for r in rings) == [(1, 1.0, 4), (1, 25.0, 4), (2, 1.0, 4)]


def test_lines_in_polygons(spark):
    edge = spatial.edges(polygons(spark, [(1, [[(0, 0), (100, 0), (100, 100), (0, 100)]]), (2, [[(50, -10), (150, -10), (150, 60), (50, 60)]])]))
    lines = [(1, [(-50, 50), (200, 50)]), (2, [(10, 10), (20, 20)]), (3, [(160, 0), (160, 50)]), (4, [(500, 500), (600, 600)]), (5, [(-50, 70), (50, 70), (50, 500)])]
    df = frame(spark, [(i, [{"x": float(x), "y": float(y)} for x, y in c]) for i, c in lines], "id long, coords array<struct<x:double,y:double>>")
    segs = vector.segments(df, "id", "coords")
    got = {r["id"]: round(r["inside_len"], 6) for r in vector.length_inside(segs, edge, "id", tile=40.0).collect()}
    assert got == {1: 150.0, 2: round(math.hypot(10, 10), 6), 5: 80.0}
    assert {r["id"] for r in vector.length_within(segs, edge, "id", 15.0, tile=40.0).where("near_len > 0").collect()} == {1, 2, 3, 5}


def test_simplify_keeps_what_stands_off(spark):
    df = frame(spark, [([{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 0.5}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 9.0}],), (None,)], "c array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(vector.simplify("c", F.lit(1.0))).collect()]
    assert [tuple(p) for p in got[0]] == [(0.0, 0.0), (10.0, 0.0), (10.0, 9.0)] and got[1] is None


def test_utm_on_known_points(spark):
    got = spark.range(1).select(utm(F.lit(123.0), F.lit(0.0)).alias("a"), utm(F.lit(121.0), F.lit(14.5)).alias("b")).first()
    assert abs(got["a"]["x"] - 500000) < 1e-6 and abs(got["a"]["y"]) < 1e-6
    # metres for a small step north and east agree with the ellipsoid's radii of curvature and the point scale
    step = spark.range(1).select(utm(F.lit(121.0), F.lit(14.5001)).alias("n"), utm(F.lit(121.0001), F.lit(14.5)).alias("e")).first()
    north = math.hypot(step["n"]["x"] - got["b"]["x"], step["n"]["y"] - got["b"]["y"])
    east = math.hypot(step["e"]["x"] - got["b"]["x"], step["e"]["y"] - got["b"]["y"])
    e2, s = 0.00669437999014, math.sin(math.radians(14.5))
    scale = 0.9996 * (1 + ((got["b"]["x"] - 500000) / 6378137) ** 2 / 2)
    assert abs(north - scale * math.radians(1e-4) * 6378137 * (1 - e2) / (1 - e2 * s * s) ** 1.5) < 1e-3
    assert abs(east - scale * math.radians(1e-4) * 6378137 / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(14.5))) < 1e-3


def test_roads_and_summary(spark):
    at = lambda x, y: {"x": x, "y": y}
    rows = [(1, "motorway", "", "SLEX", [at(121.0, 14.5), at(121.01, 14.5)]), (2, "primary", "", "Local", [at(121.0, 14.5), at(121.01, 14.5)]), (3, "trunk", "N1", "", [at(121.5, 14.9), at(121.51, 14.9)]), (4, "motorway_link", "", "x", [at(121.0, 14.5), at(121.01, 14.5)])]
    df = frame(spark, rows, "osm_id long, highway string, ref string, name string, coords array<struct<x:double,y:double>>")
    middle = spark.range(1).select(utm(F.lit(121.005), F.lit(14.5)).alias("p")).first()["p"]
    water = spatial.edges(polygons(spark, [(1, [[(middle["x"], middle["y"] - 500), (middle["x"] + 5000, middle["y"] - 500), (middle["x"] + 5000, middle["y"] + 500), (middle["x"], middle["y"] + 500)]])]))
    got = {r["osm_id"]: r for r in roads.exposure(df, water, True).collect()}
    assert set(got) == {1, 3} and got[1]["exposure"] == "flooded" and abs(got[1]["fraction"] - 0.5) < 0.01 and got[3]["exposure"] == "clear"
    assert {r["exposure"] for r in roads.exposure(df, water, False).collect()} == {"unknown"}
    s = roads.corridor_summary(roads.exposure(df, water, True)).collect()
    assert len(s) == 1 and s[0]["flooded"] == 1 and s[0]["clear"] == 0


def test_evidence_bundle(spark):
    points = frame(spark, [(1, 0, 121.05, 14.05), (1, 1, 121.5, 14.05), (2, 0, 122.0, 15.0), (3, 0, 121.105, 14.05)], "id long, i int, lon double, lat double")
    samples = frame(spark, [(7, 14.05, 121.051, 0.9), (8, 15.001, 122.0, 0.45)], "site_id long, lat double, lon double, score double")
    edge = spatial.edges(polygons(spark, [(1, [[(121.0, 14.0), (121.1, 14.0), (121.1, 14.05), (121.1, 14.1), (121.0, 14.1)]])]))
    got = {r["id"]: (r["recurrence"], r["recorded"], r["outcome"]) for r in lookup.evidence(points, samples, edge).collect()}
    assert got == {1: ("intersects", "intersects", "modelled_and_recorded"), 2: ("near", "clear", "modelled_not_recorded"), 3: ("clear", "near", "neither")}


def test_split_is_disjoint_whatever_the_partitions(spark):
    ids = spark.range(101).withColumnRenamed("id", "event")
    a = {tuple(r) for r in ranking.split_ids(ids, "event", 0.3, "9").collect()}
    b = {tuple(r) for r in ranking.split_ids(ids.unionByName(ids).repartition(7), "event", 0.3, "9").collect()}
    assert a == b and sum(g == "holdout" for _, g in a) == 30 and len(a) == 101


def test_gates(spark):
    checks = gates.check(frame(spark, [(1, "d"), (-1, None)], "x int, disclaimer string"), [("positive", "fail", F.col("x") < 0), ("known", "warn", F.lit(False))])
    assert [(r["n_bad"], r["ok"]) for r in checks.orderBy("check_name").collect()] == [(0, True), (1, False)]
    with pytest.raises(gates.GateError, match="positive"):
        gates.enforce(checks)
    assert gates.governed(frame(spark, [("d",), ("D",), (None,)], "disclaimer string"), "d").count() == 2
    assert gates.forbidden_columns(spark.sql("select named_struct('Email', 1, 'ok', array(named_struct('phone', 2))) a"), ["email", "phone"]) == ["a.Email", "a.ok.phone"]


def test_dimension_keeps_empty_members(spark):
    out = rollups.by_dimension(frame(spark, [("b", 2.0)], "k string, v double"), "k", ["a", "b", "c"], [F.count("*").alias("n"), F.sum("v").alias("s")], ["n", "s"])
    assert [tuple(r) for r in out.orderBy("ordinal").collect()] == [(0, "a", 0, 0.0), (1, "b", 1, 2.0), (2, "c", 0, 0.0)]


def test_accountability_end_to_end(spark):
    raw = [
        ("P1", "Drainage of the river", "Flood Control and Drainage", "₱5,000,000", "Completed", 14.05, 121.05, {"region": "R", "province": "Rizal"}, "2024-01-10", "2023-01-01", "2024"),
        ("P2", "Seawall", "GAA 2024", "60000000", "On-going", 99.0, 121.0, {"region": "R", "province": "Bulacan 1st DEO"}, "2024-06-10", None, "nan"),
        ("P3", "Road with drainage", "Roads", "1", "Completed", 14.0, 121.0, {"region": "R", "province": "Rizal"}, None, None, None),
        ("P1", "Drainage of the river", "Flood Control and Drainage", "7000000", "Completed", 14.05, 121.05, {"region": "R", "province": "Rizal"}, "2024-01-10", "2023-01-01", "2024"),
        ("nan", "Dike", "", "1", None, None, None, {"region": None, "province": None}, None, None, None),
        ("P4", "Dike", "", "9", None, None, None, {"region": None, "province": "Nowhere"}, None, None, None),
    ]
    schema = "contractId string, description string, category string, contractCost string, status string, latitude double, longitude double, location struct<region:string,province:string>, completionDate string, startDate string, infraYear string"
    fact = accountability.projects(frame(spark, raw, schema))
    assert sorted(r["project_id"] for r in fact.collect()) == ["P1", "P1", "P2", "P4"]
    box = polygons(spark, [(0, [[(121.0, 14.0), (121.1, 14.0), (121.1, 14.1), (121.0, 14.1)]])], "idx long")
    provinces = frame(spark, [(0, "Rizal", 0.7), (1, "Bulacan", None)], "idx long, name string, recurrence_score double")
    located = accountability.located(fact, spatial.edges(box, "idx"), provinces)
    passes = spatial.edges(polygons(spark, [(0, [[(121.0, 14.0), (121.2, 14.0), (121.2, 14.2), (121.0, 14.2)]])])).withColumn("day", F.to_date(F.lit("2024-07-30"))).drop("poly_id")
    findings = frame(spark, [(1, "Rizal", "drainage river", "ghost"), (0, "Rizal", "something else", "no")], "seq int, province string, description string, finding string")
    full = accountability.with_findings(accountability.with_passes(located, passes), findings).persist()
    rows = {(r["project_id"], r["contract_amount"]): r for r in full.collect()}
    assert rows["P1", 5e6]["province_name"] == "Rizal" and rows["P1", 5e6]["finding"] == "ghost" and len(rows["P1", 7e6]["later_passes"]) == 1
    assert rows["P2", 6e7]["province_name"] == "Bulacan" and rows["P2", 6e7]["confidence"] == 0.6 and rows["P4", 9.0]["province_name"] is None
    by = {r["province_name"]: r for r in accountability.by_province(full).collect()}
    assert by["Rizal"]["allocation"] == 12e6 and by["Rizal"]["n_completed_then_flooded"] == 2 and by["Rizal"]["warrants"] and not by["Bulacan"]["warrants"] and set(by) == {"Rizal", "Bulacan"}
    assert sum(r["n_projects"] for r in accountability.by_type(full).collect()) == 4
    assert [r["n_projects"] for r in accountability.by_tranche(full).orderBy("ordinal").collect()] == [3, 0, 1, 0, 0]
    assert {r["project_id"]: r["contract_amount"] for r in accountability.by_id(full, ["contract_amount"]).collect()} == {"P1": 7e6, "P2": 6e7, "P4": 9.0}
