import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import normalise
from tidemark.operators import gates
from tidemark.plans import accountability
from tidemark.sources import layers, sinks

PROPS = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])
SQUARE = [[0, 0], [1, 0], [1, 1], [0, 0]]


def feature(kind, coordinates=None, **more):
    return {"type": "Feature", "geometry": {"type": kind, **({"coordinates": coordinates} if coordinates is not None else {}), **more}, "properties": {"name": kind, "score": 0.5}}


def test_geojson_kinds(spark, tmp_path):
    features = [
        feature("Point", [121.0, 14.0]), feature("LineString", [[0, 0], [1, 1]]), feature("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), feature("Polygon", [SQUARE]), feature("MultiPolygon", [[SQUARE], [SQUARE, SQUARE]]),
        feature("GeometryCollection", geometries=[{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [SQUARE]}]), {"type": "Feature", "geometry": None, "properties": {}},
    ]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "_meta": {"scan_status": "ok"}, "features": features}))
    meta, rows = layers.geojson(spark, str(path), PROPS)
    assert meta.first()["scan_status"] == "ok"
    got = {r["name"]: r for r in rows.collect()}
    assert tuple(got["Point"]["point"]) == (121.0, 14.0) and len(got["MultiLineString"]["line"]) == 4 and len(got["LineString"]["line"]) == 2
    assert [len(got[n]["rings"]) for n in ("Point", "Polygon", "MultiPolygon", "GeometryCollection")] == [0, 1, 3, 1] and len(got) == 6


def test_a_missing_layer_is_empty(spark, tmp_path):
    meta, rows = layers.geojson(spark, str(tmp_path / "none.geojson"), PROPS)
    assert meta.count() == 0 and rows.count() == 0


def test_road_export(spark, tmp_path):
    way = lambda i, cls, n=2: {"type": "way", "id": i, "tags": {"highway": cls, "name": "x"}, "geometry": [{"lon": 121.0 + k, "lat": 14.0} for k in range(n)]}
    path = tmp_path / "roads.json"
    path.write_text(json.dumps({"elements": [way(1, "motorway"), way(2, "residential"), way(3, "trunk_link", 1), {"type": "node", "id": 4}, way(5, "primary_link", 3)]}))
    got = {r["osm_id"]: len(r["coords"]) for r in layers.roads(spark, str(path)).collect()}
    assert got == {1: 2, 5: 3}


def test_manifests(spark):
    radar = json.dumps({"radar": {"past": [{"time": 5, "path": "a"}, {"time": 9, "path": "b"}]}})
    stac = json.dumps({"features": [{"properties": {"datetime": "2024-01-02T00:00:00Z"}}, {"properties": {"datetime": "2024-03-02T00:00:00Z"}}, {"properties": {"datetime": "odd"}}]})
    xml = "<Layer><ows:Identifier>B</ows:Identifier><Dimension><Default>2024-05-06</Default></Dimension></Layer>"
    r = spark.range(1).select(layers.latest_frame(F.lit(radar)).alias("f"), layers.newest_item(F.lit(stac)).alias("s"), layers.capability_date(F.lit(xml), ["A", "B"]).alias("d")).first()
    assert tuple(r["f"]) == (9, "b") and r["s"].month == 3 and r["d"].isoformat() == "2024-05-06"


def test_array_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=np.ones((5, 64), np.float32), y=np.arange(5, dtype=np.int8), group=np.array(["train"] * 5), lon=np.zeros(5), lat=np.ones(5))
    rows = layers.arrays(spark, str(tmp_path / "a.npz")).collect()
    assert [r["y"] for r in rows] == [0, 1, 2, 3, 4] and len(rows[0]["embedding"]) == 64 and rows[0]["grp"] == "train"


def test_layers_are_written_honestly(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "name string, x double, y double")
    text = sinks.feature_json("Point", F.array("x", "y"), ["name"])
    for status, n in (("ok", 1), ("low_confidence", 0)):
        sinks.write_layer(df, text, {"scan_status": status}, str(tmp_path / status))
        assert spark.read.text(str(tmp_path / status / "features")).count() == n
        assert json.loads(spark.read.text(str(tmp_path / status / "meta")).first()[0]) == {"scan_status": status}
    assert json.loads(spark.read.text(str(tmp_path / "ok" / "features")).first()[0])["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}


def test_governed_writes(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "name string")
    sinks.write_governed(df, str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g"))
    assert back.first()["disclaimer"] == sinks.DISCLAIMER
    sinks.write_governed(back, str(tmp_path / "h"), expect_governed=True)
    with pytest.raises(gates.GateError):
        sinks.write_governed(back.withColumn("disclaimer", F.concat("disclaimer", F.lit(" "))), str(tmp_path / "i"), expect_governed=True)


def test_cache_merge_is_sorted_and_rounded(spark):
    old = spark.createDataFrame([("b", 1.23456), ("a", 2.0)], "id string, v double")
    new = spark.createDataFrame([("b", 9.87654), ("c", None)], "id string, v double")
    once = sinks.merged_cache(old, new)
    assert [tuple(r) for r in once.collect()] == [("a", 2.0), ("b", 9.877), ("c", None)]
    assert [tuple(r) for r in sinks.merged_cache(once, once).collect()] == [tuple(r) for r in once.collect()]


def test_exact_split_and_templates():
    train, hold, digest = sinks.exact_split(range(100, 157))
    assert len(hold) == 17 and not set(train) & set(hold) and len(digest) == 64 and sinks.exact_split(list(range(156, 99, -1)))[2] == digest
    assert sinks.filled("F1 {{METRIC:f1}}.", {"f1": 0.95}) == "F1 0.95."
    with pytest.raises(KeyError):
        sinks.filled("{{METRIC:zz}}", {})


def test_reliability_points(spark):
    df = spark.createDataFrame([(0, 0.02), (1, 0.04), (1, 1.0)], "y int, p double")
    assert [tuple(r) for r in sinks.curve(df, 10).orderBy("bin").collect()] == [(0, 2, 0.03, 0.5), (9, 1, 1.0, 1.0)]


def test_row_numbers_don_t_depend_on_the_layout(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("_file"))
    rows.write.parquet(str(tmp_path / "one"))
    rows.repartitionByRange(7, "k").sortWithinPartitions("k").write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / "many"))
    one, many = (layers.numbered(spark, str(tmp_path / n)) for n in ("one", "many"))
    assert sorted(map(tuple, one.select("k", "_row").collect())) == [(i, i) for i in range(1000)]
    assert sorted(map(tuple, many.select("k", "_row").collect())) == [(i, i) for i in range(1000)]
    assert many.columns == ["k", "title", "_file", "_row"]
    assert many.select(normalise.record_id(many, "project_id").alias("i")).where("i = 'DPWH-999'").count() == 1
    works = spark.range(0, 30, 1, 1).select(F.lit("Flood control and drainage").alias("category"), F.concat(F.lit("Dike "), "id").alias("title"))
    works.write.parquet(str(tmp_path / "works"))
    got = accountability.projects(layers.numbered(spark, str(tmp_path / "works"))).select("project_id", "title").collect()
    assert sorted(map(tuple, got)) == sorted((f"DPWH-{i}", f"Dike {i}") for i in range(30))
