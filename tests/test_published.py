import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalise
from tidemark.operators import gates, joins, rollups, spatial
from tidemark.plans import accountability, exposure, lookup
from tidemark.sources import scenes, shared


def km(a, b):
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))


def test_neighbours_across_the_date_line_and_at_the_poles(spark):
    rng = random.Random(4)
    places = [(i, *p) for i, p in enumerate([(0.0, 179.95), (0.0, -179.95), (0.1, 180.0), (89.95, 10.0), (89.9, -170.0), (-89.99, 0.0), (60.0, -180.0), (60.0, 179.9), (90.0, 0.0)])]
    places += [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(400 + i, rng.uniform(10, 10.5), rng.uniform(20, 20.5)) for i in range(60)]
    points = spark.createDataFrame(places + [(999, None, 1.0)], "id long, lat double, lon double")
    sites = points.where("id % 2 = 0").withColumnRenamed("id", "site_id")
    far = {i: [(km((a, b), (c, d)), s) for s, c, d in places if s % 2 == 0] for i, a, b in places}
    for reach in (15.0, 90.0, 2000.0):
        got = {(r["id"], r["site_id"]) for r in spatial.within_km(points, sites, reach).collect()}
        assert got == {(i, s) for i, rows in far.items() for d, s in rows if d <= reach}
    got = {r["id"]: r["site_id"] for r in spatial.nearest(points, sites, 0.5).collect()}
    assert got == {i: min((round(d, 9), s) for d, s in rows)[1] for i, rows in far.items()}
    assert spatial.nearest(points, sites.limit(0)).count() == 0


def test_a_token_of_all_rows_makes_no_pair_of_its_own(spark):
    rows = [(i, "a", ["all", f"x{i}", f"y{i}", f"z{i % 40}"]) for i in range(200)] + [(900, "a", []), (901, "b", ["all"]), (902, "b", ["all"])]
    left = spark.createDataFrame(rows, "left_id long, p string, tokens array<string>")
    got = {(r[0], r[1]) for r in joins.jaccard_join(left, left.withColumnRenamed("left_id", "right_id"), ["p"], 0.7).collect()}
    assert got == {(i, i) for i, _, t in rows if t} | {(901, 902), (902, 901)}


def test_ranked_metrics_over_many_scores(spark):
    rng = random.Random(6)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(3000)]
    got = rollups.ranked_metrics(spark.createDataFrame(rows, "y int, s double"), F.col("y"), F.col("s")).collect()[0]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got["auc"] == round(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg), 6)
    assert rollups.ranked_metrics(spark.createDataFrame([], "y int, s double"), F.col("y"), F.col("s")).collect()[0]["auc"] is None


def test_scenes_static_layers_and_events(spark, tmp_path):
    collection = spark.createDataFrame([(1, "2024-01-05", "IW", ["VV", "VH"], 0.0, 0.0, 1.0, 1.0), (2, "2024-01-05", "EW", ["VV", "VH"], 0.0, 0.0, 1.0, 1.0), (3, "2024-02-01", "IW", ["VV"], 0.0, 0.0, 1.0, 1.0), (4, "2024-01-09", "IW", ["VH"], 5.0, 5.0, 6.0, 6.0), (5, "2024-01-02", "IW", ["VH"], 0.5, 0.5, 2.0, 2.0)], "scene_id long, day string, mode string, pols array<string>, west double, south double, east double, north double").withColumn("day", F.col("day").cast("date"))
    chosen = scenes.scenes(collection, (0, 0, 1, 1), "2024-01-01", "2024-02-01", "IW", "VH")
    assert [r["scene_id"] for r in chosen.orderBy("scene_id").collect()] == [1, 5]
    assert [str(r["day"]) for r in scenes.acquisition_dates(chosen).collect()] == ["2024-01-02", "2024-01-05"]
    cells = collection.select("scene_id", "day", F.lit(3).alias("row"), F.lit(4).alias("col"), F.lit(-20.0).alias("vh"), F.lit(0.0).alias("vv"))
    scenes.write_cells(cells, f"{tmp_path}/cells")
    found = scenes.scene_cells(spark.read.parquet(f"{tmp_path}/cells"), chosen, ["vh"])
    assert {r["scene_id"] for r in found.collect()} == {1, 5} and "vv" not in found.columns
    spark.createDataFrame([(0, 0, 1.5)], "row int, col int, value double").write.parquet(f"{tmp_path}/water")
    spark.createDataFrame([(0, 1, 7.0)], "row int, col int, value double").write.parquet(f"{tmp_path}/slope")
    layers = scenes.static_layers(spark, {"water": f"{tmp_path}/water", "slope": f"{tmp_path}/slope", "none": f"{tmp_path}/none"})
    assert sorted(map(tuple, layers.collect())) == [(0, 0, 1.5, None, None), (0, 1, None, 7.0, None)]
    events = spark.createDataFrame([(7, 0, 0.0, 0.0, 1.0, 1.0, {"cause": "rain"}), (8, 86_400_000, 9.0, 9.0, 9.5, 9.5, {})], "event_id long, started_ms long, west double, south double, east double, north double, properties map<string,string>")
    images = scenes.event_images(events, spark.createDataFrame([(7, 1, 1, 1), (8, 1, 1, 1)], "event_id long, row int, col int, flooded int"), (0, 0, 2, 2)).collect()
    assert [(r["event_id"], str(r["began"]), r["properties"]["cause"]) for r in images] == [(7, "1970-01-01", "rain")]
    assert scenes.in_country(spark.createDataFrame([("Here", 1), ("There", 2)], "ADM0_NAME string, u int"), "Here").count() == 1


def test_cached_tables_and_views_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/kept"
    assert [scenes.cached(spark, path, make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    scenes.cached(spark, path, make, refresh=True)
    # what is refreshed may be read to make it
    assert scenes.cached(spark, path, lambda: spark.read.parquet(path).unionByName(spark.range(10, 12)), refresh=True).count() == 5
    with pytest.raises(ValueError):
        scenes.cached(spark, f"{tmp_path}/empty", lambda: spark.range(0))
    with pytest.raises(ValueError):
        scenes.cached(spark, path, lambda: spark.range(0), refresh=True)
    assert scenes.cached(spark, path, make).count() == 5
    assert len(made) == 2 and [scenes.view(spark, "kept_view", make).count() for _ in range(2)] == [3, 3] and len(made) == 3


def test_overlap_of_polygons_by_cells(spark):
    shape = [(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), (2, [[(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)]])]
    polygons = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r] for r in rs]) for i, rs in shape], "poly_id long, rings array<array<struct<x:double,y:double>>>")
    units = exposure.polygon_cells(spatial.edges(polygons), 1.0)
    assert {(r["poly_id"], r["row"], r["col"]) for r in units.collect()} == {(1, a, b) for a in range(4) for b in range(4)} | {(2, a, b) for a in (10, 11) for b in (10, 11)}
    floods = spark.createDataFrame([("d1", 0, 0), ("d1", 0, 1), ("d1", 0, 1), ("d2", 3, 3), ("d2", 50, 50)], "day string, row long, col long")
    over = exposure.overlap(units, floods, 2.0, "poly_id")
    assert sorted(map(tuple, over.collect())) == [(1, "d1", 4.0, 2 / 16), (1, "d2", 2.0, 1 / 16)]
    assert sorted(map(tuple, exposure.peak(units, over, "poly_id").collect())) == [(1, 2 / 16), (2, 0.0)]


def test_gates_of_schemas_and_records(spark):
    df = spark.createDataFrame([], "by_type array<struct<title:string>>, flagged array<struct<title:string,n:int>>, names array<string>, n int, share double")
    assert gates.named_arrays(df, ["title"], ["by_type"]) == ["flagged"]
    assert gates.count_columns(df, ["n", "share", "gone"]) == ["share", "gone"]
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "title string, v double")
    with pytest.raises(ValueError, match="numbers"):
        normalise.record_id(rows, "project_id")
    good, bad = normalise.isolated(rows, [("no value", F.col("v").isNull()), ("never", F.col("v") > 5)])
    assert [r["title"] for r in good.collect()] == ["a"] and [(r["title"], r["reason"]) for r in bad.collect()] == [("b", "no value")]
    fact = spark.createDataFrame([("1", 5.0, 1), ("2", None, None)], "project_id string, contract_amount double, idx int")
    cache = spark.createDataFrame([("1", True, "weak")], "id string, satellite_checked boolean, built_change_signal string")
    assert sorted((r["project_id"], r["satellite_checked"], r["built_change_signal"]) for r in accountability.with_satellite(fact, cache).collect()) == [("1", True, "weak"), ("2", False, None)]
    assert tuple(accountability.totals(fact).collect()[0]) == (2, 5.0, 1)


def test_marks_are_removed_composed_or_not(spark):
    df = spark.createDataFrame([("Ñandú ÀÉÎõü ế ǘ",), ("étude  å!",), ("日本 x",)], "t string")
    assert [r[0] for r in df.select(normalise.plain_text(F.col("t"))).collect()] == ["nandu aeiou e u", "etude a", "x"]


def test_a_cluster_needs_a_shared_folder(spark):
    assert shared.shared_folder(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_evidence_bundle_of_five_layers(spark):
    xy = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = lambda x, y, w: [xy((x, y), (x + w, y), (x + w, y + w), (x, y + w))]
    points = spark.createDataFrame([(1, 0, 121.0, 14.0), (1, 1, 121.5, 14.0), (2, 0, 130.0, 20.0)], "id long, i int, lon double, lat double")
    ring = "rings array<array<struct<x:double,y:double>>>"
    layer = lookup.Layer
    recurrence = layer(spark.createDataFrame([(1, 14.0, 121.0, 0.9), (2, 14.0, 121.5, 0.3), (3, 20.0, 130.5, 0.8)], "site_id long, lat double, lon double, score double"), None, "2017")
    history = layer(spark.createDataFrame([(5, 0, square(120.9, 13.9, 1.0)), (4, 3, square(121.4, 13.9, 0.2)), (6, None, square(129.0, 19.0, 2.0))], f"idx long, events int, {ring}"))
    latest = layer(spark.createDataFrame([(1, square(120.998, 14.005, 0.004))], f"poly_id long, {ring}"), "ok", "2024-07-25")
    rain = layer(spark.createDataFrame([(1, 14.02, 121.5, "red"), (2, 14.0, 121.0, None)], "site_id long, lat double, lon double, flag string"))
    road = layer(spark.createDataFrame([(2, "B", "near", xy((121.5, 14.0), (122, 14))), (1, "A", "flooded", xy((121.004, 14.0), (121.002, 14.0))), (3, "A", "flooded", xy((121.0, 14.0))), (4, "C", "clear", xy((121.0, 14.0))), (5, None, "near", xy((121.0, 14.001)))], "seq long, name string, exposure string, coords array<struct<x:double,y:double>>"))
    got = {(r["id"], r["layer"]): r for r in lookup.bundle(points, recurrence, history, latest, rain, road).collect()}
    state = lambda i: [got[i, n]["state"] for n in ("recurrence", "history", "latest", "rain", "roads")]
    assert len(got) == 10 and state(1) == ["intersects", "intersects", "near", "near", "intersects"] and state(2) == ["clear", "near", "clear", "clear", "clear"]
    assert got[1, "history"]["number"] == 3 and got[1, "latest"]["as_of"] == "2024-07-25" and got[1, "roads"]["names"] == ["A (flooded)", "B (near)", "unnamed road (near)"]
    folded = {(r["id"], r["layer"]): r for r in lookup.bundle(points, recurrence, history, layer(None), layer(rain.rows, "no_data"), layer(road.rows, "no_usable_pass", "d"), compatible=True).collect()}
    assert folded[1, "recurrence"]["score"] == 0.9 and [folded[2, n]["state"] for n in ("latest", "rain", "roads")] == ["unavailable", "withheld", "withheld"] and folded[2, "roads"]["as_of"] == "d"
