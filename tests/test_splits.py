import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import layers, splits

PROPS = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])


def whole(spark, path, key, root, element):
    """The document read by one task, by Spark's own reader."""
    doc = spark.read.schema(T.StructType([*root.fields, T.StructField(key, T.ArrayType(element))])).option("multiLine", True).json(path)
    return doc.select(F.posexplode(key).alias("seq", "e"))


def awkward(rng, n):
    """Features with escapes, brackets inside texts, nested features, other key orders and blanks."""
    out = []
    for i in range(n):
        name = rng.choice(['a "quoted" {', "back\\slash\\\\", '"type":"Feature"', "é[ü]{", "", "}\n]", '\\"', '{"type":"Feature","geometry":null}'])
        x, y = 120 + i % 10, 10 + i // 10
        geometry = rng.choice([{"type": "Point", "coordinates": [x, y]}, {"type": "Polygon", "coordinates": [[[x, y], [x + 0.5, y], [x, y + 0.5], [x, y]]]}, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [[[x, y], [x + 0.5, y], [x, y + 0.5], [x, y]]]}]}, None])
        members = [("type", "Feature"), ("properties", {"name": name, "n": i, "children": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}]}), ("geometry", geometry)]
        rng.shuffle(members)
        out.append(dict(members))
    return out


@pytest.mark.parametrize("layout", ["meta_first", "meta_last", "indented"])
@pytest.mark.parametrize("range_bytes", [61, 700, 1 << 25])
def test_ranges_give_what_one_task_reads(spark, tmp_path, layout, range_bytes, monkeypatch):
    rng = random.Random(3)
    if range_bytes == 61:
        monkeypatch.setattr(splits, "LOOK_BACK", 64)
    features = awkward(rng, 4 if range_bytes == 61 else 40)
    meta, crs = {"scan_status": "ok", "list": [{"type": "Feature"}], "note": '"features":['}, {"type": "name", "properties": {"name": "x"}}
    root = {"type": "FeatureCollection", "_meta": meta, "crs": crs, "others": [{"type": "Feature", "geometry": None}], "features": features}
    if layout == "meta_last":
        root = {"features": features, "others": [], "crs": crs, "_meta": meta}
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps(root, indent=2 if layout == "indented" else None, ensure_ascii=layout == "meta_last"))
    feature = T.StructType([T.StructField("properties", PROPS), T.StructField("geometry", layers._GEOMETRY)])
    doc, elements = layers._documents(spark, str(path), "features", T.StructType([T.StructField("_meta", T.StructType([T.StructField("scan_status", T.StringType())]))]), feature, range_bytes=range_bytes)
    want = whole(spark, str(path), "features", T.StructType([]), feature)
    shown = lambda df: sorted(re.sub(r"\\n| ", "", repr(r)) for r in df.collect())
    assert shown(elements) == shown(want)
    assert [r[0].scan_status for r in doc.collect()] == ["ok"]
    size = path.stat().st_size
    assert elements.rdd.getNumPartitions() == -(-size // range_bytes)
    _, inside = layers.geojson(spark, str(path), PROPS, box=(121.2, 10.2, 123.8, 11.2), range_bytes=range_bytes)
    _, every = layers.geojson(spark, str(path), PROPS, range_bytes=range_bytes)
    extent = lambda r: [p for ring in r["rings"] for p in ring] or [r["point"]]
    hit = {r["seq"] for r in every.collect() if min(p["x"] for p in extent(r)) <= 123.8 and max(p["x"] for p in extent(r)) >= 121.2 and min(p["y"] for p in extent(r)) <= 11.2 and max(p["y"] for p in extent(r)) >= 10.2}
    assert {r["seq"] for r in inside.collect()} == hit


def test_readers_apply_box_and_class(spark, tmp_path):
    ways = [{"type": "way", "id": i, "tags": {"highway": ["trunk", "residential", "primary_link"][i % 3], "name": f"r{i}"}, "geometry": [{"lon": 120 + i, "lat": 14}, {"lon": 120.5 + i, "lat": 14.5}]} for i in range(30)]
    path = tmp_path / "roads.json"
    path.write_text(json.dumps({"version": "1", "elements": [*ways, {"type": "node", "id": 99}]}))
    every = layers.roads(spark, str(path), range_bytes=300)
    assert sorted(r["osm_id"] for r in every.collect()) == [i for i in range(30) if i % 3 != 1]
    some = layers.roads(spark, str(path), box=(125, 13, 128.2, 15), range_bytes=300)
    assert sorted(r["osm_id"] for r in some.collect()) == [5, 6, 8]
    files = splits.files_of(spark, str(path))
    _, raw = splits.json_array(spark, files, "elements", box=(125, 13, 128.2, 15), match=(["tags", "highway"], "^trunk"), range_bytes=300)
    assert [json.loads(r["element"])["id"] for r in raw.collect()] == [6] and raw.where("seq = 6").count() == 1


def test_folders_of_documents_and_documents_without_the_array(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.json").write_text(json.dumps({"_meta": {"scan_status": f"s{k}"}, "features": [{"properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [i, k]}} for i in range(5)]}))
    (tmp_path / "part-3.json").write_text(json.dumps({"_meta": {"scan_status": "none"}, "features": []}))
    (tmp_path / "part-4.json").write_text('{"_meta": {"scan_status": "bare"}}')
    meta, rows = layers.geojson(spark, str(tmp_path), PROPS, range_bytes=100)
    assert sorted(r["scan_status"] for r in meta.collect()) == ["bare", "none", "s0", "s1", "s2"]
    assert sorted((r["seq"], r["n"], r["point"]["y"]) for r in rows.collect()) == sorted((i, i, float(k)) for i in range(5) for k in range(3))
