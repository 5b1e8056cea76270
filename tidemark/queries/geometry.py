"""Exact geometry, zones and layers of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo
from tidemark.operators import outlines, overlay, raster, spatial, vector
from tidemark.plans import exposure, roads
from tidemark.queries.base import query, table
from tidemark.queries.evidence import _INSIDE_SQL, _edge_rows, _points, _polygons
from tidemark.sources import layers
from tidemark.sources.shared import shared_folder


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h))


def _flood_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of every customer, by market segment; every fifth has a hole."""
    k = F.col("c_custkey")
    x, y, w, h = k * 7919 % 997, k * 104729 % 499, 3 + k % 7, 3 + k % 5
    hole = F.when(k % 5 == 0, F.array(_box(x, y, w, h), _box(x + 1, y + 1, F.lit(1), F.lit(1)))).otherwise(F.array(_box(x, y, w, h)))
    return table(spark, sf_dir, "customer").select(k.alias("poly_id"), F.col("c_mktsegment").alias("day"), hole.alias("rings"))


_FLOOD_CELLS = """c AS (SELECT c_custkey AS k, c_mktsegment AS day, CAST(c_custkey * 7919 % 997 AS BIGINT) AS x, CAST(c_custkey * 104729 % 499 AS BIGINT) AS y, CAST(3 + c_custkey % 7 AS BIGINT) AS w, CAST(3 + c_custkey % 5 AS BIGINT) AS h FROM customer),
r AS (SELECT k, day, x, y, h, unnest(range(x, x + w)) AS cx FROM c), f AS (SELECT DISTINCT day, cx, cy FROM (SELECT k, day, x, y, cx, unnest(range(y, y + h)) AS cy FROM r) WHERE NOT (k % 5 = 0 AND cx = x + 1 AND cy = y + 1))"""


@query(f"WITH {_FLOOD_CELLS} SELECT day, CAST(count(*) AS DOUBLE) AS area FROM f GROUP BY day")
def q_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of overlapping polygons."""
    edge = spatial.edges(_flood_boxes(spark, sf_dir), also=("day",))
    return overlay.union_area(edge, "poly_id", "day", 16.0).select(F.col("set").alias("day"), F.round("area", 6).alias("area"))


@query(f"""
WITH {_FLOOD_CELLS}, u AS (SELECT n_nationkey AS unit, CAST(n_nationkey % 5 * 190 AS BIGINT) AS ux, CAST(n_nationkey // 5 * 95 AS BIGINT) AS uy, CAST(200 + n_nationkey AS BIGINT) AS uw, CAST(100 + n_nationkey AS BIGINT) AS uh FROM nation)
SELECT unit, day, CAST(count(*) AS DOUBLE) AS area, round(count(*) / CAST(any_value(uw * uh) AS DOUBLE), 9) AS share FROM u JOIN f ON cx >= ux AND cx < ux + uw AND cy >= uy AND cy < uy + uh GROUP BY unit, day
""")
def q_overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area of each unit under each day's floods, which overlap each other as the units do."""
    floods, n = spatial.edges(_flood_boxes(spark, sf_dir), also=("day",)), F.col("n_nationkey")
    units = table(spark, sf_dir, "nation").select(n.alias("unit"), F.array(_box(n % 5 * 190, F.floor(n / 5) * 95, 200 + n, 100 + n)).alias("rings"))
    both = overlay.intersection_area(spatial.edges(units, "unit"), floods, "unit", "poly_id", "unit", "day", 16.0)
    whole = overlay.union_area(spatial.edges(units, "unit"), "unit", "unit", 64.0).select(F.col("set").alias("a_set"), F.col("area").alias("whole"))
    return both.join(whole, "a_set").select(F.col("a_set").alias("unit"), F.col("b_set").alias("day"), F.round("area", 6).alias("area"), F.round(F.col("area") / F.col("whole"), 9).alias("share"))


_NEAR = 2.5


@query(f"""
WITH c AS (SELECT CAST(c_custkey * 7919 % 997 AS DOUBLE) AS x1, CAST(c_custkey * 104729 % 499 AS DOUBLE) AS y1, CAST(c_custkey * 7919 % 997 + 3 + c_custkey % 7 AS DOUBLE) AS x2, CAST(c_custkey * 104729 % 499 + 3 + c_custkey % 5 AS DOUBLE) AS y2 FROM customer WHERE c_custkey % 5 <> 0),
l AS (SELECT o_orderkey AS id, CAST(o_orderkey * 31 % 991 AS DOUBLE) AS a, CAST(o_orderkey * 31 % 991 + 2 + o_orderkey % 40 AS DOUBLE) AS b, o_custkey * 17 % 4990 / 10.0 + 0.05 AS y FROM orders),
g AS (SELECT id, a, b, x1, x2, greatest(0.0, y1 - y, y - y2) AS gap FROM l JOIN c ON y >= y1 - {_NEAR} AND y <= y2 + {_NEAR} AND b > x1 - {_NEAR} AND a < x2 + {_NEAR}),
i AS (SELECT id, false AS wide, greatest(a, x1) AS lo, least(b, x2) AS hi FROM g WHERE gap = 0 UNION ALL SELECT id, true, greatest(a, x1 - sqrt({_NEAR * _NEAR} - gap * gap)), least(b, x2 + sqrt({_NEAR * _NEAR} - gap * gap)) FROM g WHERE gap <= {_NEAR}),
w AS (SELECT id, wide, lo, hi, max(hi) OVER (PARTITION BY id, wide ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i WHERE lo < hi),
s AS (SELECT id, wide, sum(greatest(0.0, hi - greatest(lo, coalesce(reached, lo)))) AS len FROM w GROUP BY id, wide)
SELECT l.id, round(coalesce(sum(len) FILTER (WHERE NOT wide), 0), 6) AS inside_len, round(coalesce(sum(len) FILTER (WHERE wide), 0), 6) AS near_len FROM l LEFT JOIN s ON l.id = s.id GROUP BY l.id
""")
def q_road_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each line in the water, and at most a distance from it."""
    k = F.col("o_orderkey")
    y = F.col("o_custkey") * 17 % 4990 / 10.0 + 0.05
    lines = table(spark, sf_dir, "orders").select(k.alias("id"), F.array(_point(k * 31 % 991, y), _point(k * 31 % 991 + 2 + k % 40, y)).alias("coords"))
    water = spatial.edges(_flood_boxes(spark, sf_dir).where("poly_id % 5 <> 0"))
    segs = vector.segments(lines, "id", "coords")
    found = lines.select("id").join(vector.lengths(segs, water, "id", _NEAR, tile=16.0), "id", "left")
    return found.select("id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("inside_len", "near_len")])


@query("SELECT c_custkey AS id, round(117 + (c_custkey * 104729 % 9500) / 1000.0, 7) AS lon, round(5 + (c_custkey * 7919 % 16000) / 1000.0, 7) AS lat FROM customer")
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres and back, to a hundredth of a metre."""
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(k.alias("id"), geo.utm(117 + (k * 104729 % 9500) / 1000.0, 5 + (k * 7919 % 16000) / 1000.0).alias("m"))
    return m.select("id", geo.utm_inverse(F.col("m.x"), F.col("m.y")).alias("b")).select("id", F.round("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


@query("""
WITH l AS (SELECT o_orderkey AS id, round(120 + (o_orderkey % 900) / 1000.0, 5) AS x, round(14 + (o_orderkey % 700) / 1000.0, 5) AS y, o_orderkey % 3 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.00004 WHEN 2 THEN 0.0004 ELSE 0.002 END AS bend FROM orders)
SELECT id, CASE kind WHEN 0 THEN 'flooded' WHEN 1 THEN 'near' ELSE 'clear' END AS exposure, CASE WHEN bend > CASE WHEN kind = 2 THEN 0.001 ELSE 0.0002 END THEN 3 ELSE 2 END AS n,
  round(x, 5) AS x1, round(y, 5) AS y1, CASE WHEN bend > CASE WHEN kind = 2 THEN 0.001 ELSE 0.0002 END THEN round(y + bend, 5) ELSE round(y, 5) END AS y2 FROM l
""")
def q_published_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads simplified in metres, finely where they are wet or near, and rounded degrees."""
    k = F.col("o_orderkey")
    x, y = F.round(120 + (k % 900) / 1000.0, 5), F.round(14 + (k % 700) / 1000.0, 5)
    bend = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.00004).when(k % 4 == 2, 0.0004).otherwise(0.002)
    o = table(spark, sf_dir, "orders")
    lines = o.select(k.alias("osm_id"), F.array(_point(x, y), _point(x + 0.01, y + bend), _point(x + 0.02, y)).alias("coords"))
    exposed = o.select(k.alias("osm_id"), F.when(k % 3 == 0, "flooded").when(k % 3 == 1, "near").otherwise("clear").alias("exposure"))
    g = roads.published(lines, exposed)
    return g.select(F.col("osm_id").alias("id"), "exposure", F.size("geometry").alias("n"), F.col("geometry")[0]["x"].alias("x1"), F.col("geometry")[0]["y"].alias("y1"), F.col("geometry")[1]["y"].alias("y2"))


@query("SELECT c_custkey AS id, c_name AS name, 117 + (c_custkey * 104729 % 9500) / 1000.0 AS lon, 5 + (c_custkey * 7919 % 16000) / 1000.0 AS lat FROM customer WHERE 117 + (c_custkey * 104729 % 9500) / 1000.0 BETWEEN 120 AND 122.5 AND 5 + (c_custkey * 7919 % 16000) / 1000.0 BETWEEN 10 AND 15.5")
def q_layer_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature collections written from a table and read in ranges by many tasks, with a box that the readers apply."""
    k = F.col("c_custkey")
    lon, lat = (117 + (k * 104729 % 9500) / 1000.0).cast("double"), (5 + (k * 7919 % 16000) / 1000.0).cast("double")
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(k.alias("id"), F.col("c_name").alias("name")).alias("properties"), geometry.alias("geometry")))
    # 2,000 features a collection, whatever the size of the table
    each = table(spark, sf_dir, "customer").groupBy(F.floor(k / 2000).alias("part")).agg(F.concat(F.lit('{"type":"FeatureCollection","_meta":{"scan_status":"ok"},"features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    path = f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}"
    each.write.partitionBy("part").text(path)
    properties = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    _, found = layers.geojson(spark, path, properties, box=(120, 10, 122.5, 15.5), range_bytes=1 << 16)
    return found.select("id", "name", F.col("point.x").alias("lon"), F.col("point.y").alias("lat"))


@query(f"""
WITH e(poly_id, x1, y1, x2, y2) AS (VALUES {_edge_rows()}), c AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS row, CAST(o_orderkey % 97 AS BIGINT) AS col, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
i AS (SELECT poly_id, row, col, v FROM c JOIN e ON (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT poly_id, count(*) AS n, round(sum(v), 2) AS total, round(max(v), 2) AS peak, round(avg(v), 4) AS mean, round(arg_min(v, row * 1000 + col), 2) AS first FROM i GROUP BY poly_id
""")
def q_zonal_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, maximum, mean and first value of the cells in each polygon."""
    o = table(spark, sf_dir, "orders")
    cells = o.groupBy((F.col("o_custkey") % 50).alias("row"), (F.col("o_orderkey") % 97).alias("col")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    kinds = [F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.max("v"), 2).alias("peak"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.min_by("v", F.col("row") * 1000 + F.col("col")), 2).alias("first")]
    return exposure.zonal(cells, spatial.edges(_polygons(spark)), 1.0, kinds)


@query(f"{_INSIDE_SQL}, m AS (SELECT poly_id, count(*) AS n, avg(i.id % 101) AS mean FROM i GROUP BY poly_id), u AS (SELECT unnest([1, 2, 3, 4, 5]) AS poly_id) SELECT u.poly_id, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean FROM u LEFT JOIN m ON u.poly_id = m.poly_id")
def q_unit_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the points in each unit, 0 without any."""
    points, polygons = _points(spark, sf_dir).withColumn("v", F.col("id") % 101), _polygons(spark)
    units = polygons.select("poly_id").unionByName(spark.range(1).select(F.lit(5).alias("poly_id")))
    return exposure.unit_means(points, spatial.edges(polygons), units, "v", tile=5.0).withColumn("mean", F.round("mean", 6))


@query("""
WITH u AS (SELECT c_nationkey AS unit, -16 - (c_nationkey % 9) / 2.0 AS threshold, count(*) * 10 AS population, greatest(0, avg(c_acctbal) - 4500) AS pct FROM customer GROUP BY c_nationkey)
SELECT round(avg(threshold), 6) AS mean_threshold, CAST(sum(CASE WHEN pct > 0 THEN population ELSE 0 END) AS BIGINT) AS affected FROM u
""")
def q_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the thresholds, people of the units that are covered in part."""
    n = F.col("c_nationkey")
    units = table(spark, sf_dir, "customer").groupBy(n.alias("unit")).agg((F.count("*") * 10).alias("population"), F.greatest(F.lit(0.0), F.avg("c_acctbal") - 4500).alias("pct")).withColumn("threshold", -16 - (F.col("unit") % 9) / 2.0)
    return exposure.affected(units, "threshold", "population", "pct").withColumn("mean_threshold", F.round("mean_threshold", 6))


@query("""
WITH RECURSIVE v AS (SELECT user_id AS row, CAST(day(ts) * 24 + hour(ts) AS INTEGER) AS col, round(avg(value), 4) AS v FROM events GROUP BY 1, 2),
c AS (SELECT row, col, row * 10000 + col AS id FROM v WHERE v >= 12),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a)
SELECT n, count(*) AS polygons FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY label) WHERE n >= 3 GROUP BY n
""")
def q_flood_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the wet cells as polygons of at least three cells, counted by area; what only touches at corners is a polygon each.

    With its holes taken off, a polygon is as large as its cells are many.
    """
    e = table(spark, sf_dir, "events")
    cells = e.groupBy(F.col("user_id").alias("row"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("col")).agg(F.round(F.avg("value"), 4).alias("v"))
    found = outlines.polygons(raster.components(cells.where("v >= 12")), least_area=3.0)
    return found.groupBy(F.col("area").alias("n")).agg(F.count("*").alias("polygons"))
