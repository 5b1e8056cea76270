"""GeoJSON layers, road networks, manifests and arrays as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import normalise
from tidemark.sources import splits

_POSITION = "array<double>"
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType()), T.StructField("geometries", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])))])


def missing(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file system has nothing at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_or_empty(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Rows of a JSON document or of JSON lines; no rows if there is no file."""
    if missing(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _points(coordinates: Column, depth: int) -> Column:
    """Positions of nested coordinates (JSON text) as struct(x, y), ``depth`` lists deep."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, point)
    kind = _POSITION
    for _ in range(depth):
        kind = f"array<{kind}>"
    parsed = F.from_json(coordinates, kind)
    return point(parsed) if depth == 0 else ring(parsed) if depth == 1 else F.transform(parsed, ring) if depth == 2 else F.transform(parsed, lambda part: F.transform(part, ring))


def _polygon_rings(kind: Column, coordinates: Column) -> Column:
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return F.when(kind == "Polygon", _points(coordinates, 2)).when(kind == "MultiPolygon", F.flatten(_points(coordinates, 3))).otherwise(none)


def _documents(spark: SparkSession, path: str, key: str, root: T.StructType, element: T.DataType, box: tuple[float, float, float, float] | None = None, match: tuple[list[str], str] | None = None, range_bytes: int = splits.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc, elements): the members ``root`` of JSON documents, and seq, e of the elements of their array ``key``; large files are read by many tasks.

    Where only Spark can open the files, each is read by one task, and box and match don't apply.
    """
    if missing(spark, path):
        return spark.createDataFrame([], root), spark.createDataFrame([], T.StructType([T.StructField("seq", T.LongType()), T.StructField("e", element)]))
    files = splits.files_of(spark, path)
    if files is None:
        doc = spark.read.schema(T.StructType([*root.fields, T.StructField(key, T.ArrayType(element))])).option("multiLine", True).json(path)
        return doc.drop(key), doc.select(F.posexplode(key).alias("seq", "e")).withColumn("seq", F.col("seq").cast("long"))
    rest, elements = splits.json_array(spark, files, key, box, match, range_bytes)
    return rest.select(F.from_json("element", root).alias("d")).select("d.*"), elements.select("seq", F.from_json("element", element).alias("e"))


def in_box(points: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether the extent of points (array<struct<x,y>>) reaches into west, south, east, north."""
    west, south, east, north = box
    end = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return (end(F.array_min, "x") <= east) & (end(F.array_max, "x") >= west) & (end(F.array_min, "y") <= north) & (end(F.array_max, "y") >= south)


def geojson(spark: SparkSession, path: str, properties: T.StructType, meta: T.StructType | None = None, box: tuple[float, float, float, float] | None = None, range_bytes: int = splits.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(meta, features) of FeatureCollections; a missing file is a layer without features. A file is read in ranges, by many tasks.

    features: seq, the properties, geometry_type, point, line (points of a LineString or of all parts) and rings (of the polygonal parts of any
    geometry, also of a GeometryCollection; other parts are dropped). ``box`` (west, south, east, north) keeps the features whose extent
    reaches into it; the readers apply it before a row is made.
    """
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", _GEOMETRY)])
    root = T.StructType([T.StructField("_meta", meta or T.StructType([T.StructField("scan_status", T.StringType())]))])
    doc, features = _documents(spark, path, "features", root, feature, box, range_bytes=range_bytes)
    f = features.select("seq", "e.*").where("geometry is not null")
    kind, xy = F.col("geometry.type"), F.col("geometry.coordinates")
    parts = F.flatten(F.transform("geometry.geometries", lambda g: _polygon_rings(g["type"], g["coordinates"])))
    shaped = f.select(
        "seq", "properties.*", kind.alias("geometry_type"), F.when(kind == "Point", _points(xy, 0)).alias("point"),
        F.when(kind == "LineString", _points(xy, 1)).when(kind == "MultiLineString", F.flatten(_points(xy, 2))).alias("line"),
        F.when(kind == "GeometryCollection", parts).otherwise(_polygon_rings(kind, xy)).alias("rings"),
    )
    return doc.select("_meta.*"), shaped


def roads(spark: SparkSession, path: str, classes: str = r"^(motorway|trunk|primary)(_link)?$", box: tuple[float, float, float, float] | None = None, range_bytes: int = splits.RANGE_BYTES) -> DataFrame:
    """osm_id, highway, ref, name, coords of the ways of a road network export with at least two vertices, a class that matches and, with
    ``box`` (west, south, east, north), an extent that reaches into it. The readers apply class and box before a row is made."""
    node = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
    tags = T.StructType([T.StructField(n, T.StringType()) for n in ("highway", "ref", "name")])
    element = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("tags", tags), T.StructField("geometry", T.ArrayType(node))])
    _, found = _documents(spark, path, "elements", T.StructType([T.StructField("version", T.StringType())]), element, box, (["tags", "highway"], classes), range_bytes)
    kept = found.select("e.*").where((F.col("type") == "way") & (F.size("geometry") >= 2) & F.col("tags.highway").rlike(classes))
    out = kept.select(F.col("id").alias("osm_id"), F.col("tags.highway").alias("highway"), F.coalesce("tags.ref", F.lit("")).alias("ref"), F.coalesce("tags.name", F.lit("")).alias("name"), F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))
    return out if box is None else out.where(in_box(F.col("coords"), box))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Parquet files with _row, their place from 0 on in the order of the files' names and of the rows in each.

    A file gives the places of its rows, so that only the rows of each file are counted, and nothing is sorted; the same rows have the same
    numbers in one file or in many, and however the files are split.
    """
    place = "_tidemark_place"
    rows = spark.read.parquet(path).select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).alias(place))
    files = rows.groupBy(F.col(f"{place}.file").alias("_tidemark_file")).agg(F.count("*").alias("_tidemark_n"))
    # a row for each file
    up_to = Window.orderBy("_tidemark_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("_tidemark_file", F.coalesce(F.sum("_tidemark_n").over(up_to), F.lit(0)).alias("_tidemark_before"))
    joined = rows.join(before, F.col(f"{place}.file") == F.col("_tidemark_file"))
    return joined.withColumn(normalise.ROW, F.col("_tidemark_before") + F.col(f"{place}.at")).drop(place, "_tidemark_file", "_tidemark_before")


def latest_frame(manifest: Column) -> Column:
    """The newest past frame (struct time, path) of a radar manifest."""
    m = F.from_json(manifest, "struct<radar:struct<past:array<struct<time:bigint,path:string>>>>")
    return F.element_at(F.array_sort(m["radar"]["past"]), -1)


def newest_item(stac: Column) -> Column:
    """The latest datetime of a STAC item collection."""
    m = F.from_json(stac, "struct<features:array<struct<properties:struct<datetime:string>>>>")
    return F.array_max(F.transform(m["features"], lambda f: F.try_to_timestamp(f["properties"]["datetime"])))


def capability_date(xml: Column, products: list[str]) -> Column:
    """The default date of the first product that a capabilities document lists."""
    tries = [F.nullif(F.regexp_extract(xml, rf"(?s)<ows:Identifier>{p}</ows:Identifier>.*?<Default>(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("")) for p in products]
    return F.coalesce(*tries).try_cast("date")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """embedding, y, grp, lon, lat of array archives (X, y, group, lon, lat): the files are dealt to tasks, each is read by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(z["y"]), 4096):
                    at = slice(i, i + 4096)
                    yield pd.DataFrame({"embedding": [list(map(float, x)) for x in z["X"][at]], "y": z["y"][at].astype("int32"), "grp": z["group"][at].astype(str), "lon": z["lon"][at].astype(float), "lat": z["lat"][at].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "embedding array<float>, y int, grp string, lon double, lat double")
